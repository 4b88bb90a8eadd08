"""SentencePiece encoding and decoding with a relational lattice.

Words. A blank becomes the piece mark, one mark goes in front of a text, and the text is cut before each run of marks,
wherever no piece of the table crosses (found from the table, by classes of characters, so the cut changes no result);
a word has any length. Documents become numbers of words: each task writes its documents as chunks of word numbers to a
file in the shared folder, and gives Spark the distinct words of each chunk. Texts aren't shuffled. Words belong to parts
by their CRC-32, as many parts as there are shuffle partitions; the words of a chunk and a part travel sorted and
compressed as one row, and so do their ids on the way back.

Lattice. Of all distinct words once: substrings of the lengths that pieces with their first two characters have are
exploded and joined by equality with the piece table (broadcasts of the vocabulary, whose size the model file fixes); a character without a piece gets
an unknown edge. Edges are grouped by word, and a higher-order aggregate folds Viterbi over the end positions, then
another walks back. Unknown characters become byte pieces. Words beyond LONGEST characters, whose positions don't fit the
packed numbers, take the same join and fold in blocks of BLOCK end positions: a block's text reaches back by the longest
piece, and its fold begins with the states of as many positions before it. Their best path is that of the whole word.

Scores. A unigram model's scores are its log-probabilities. The scores of a BPE model are merge ranks, no probabilities;
for such a model a piece of rank r counts -ln(1 + r), and the best path need not be the order of merges that the
model's own library applies. Decoding is that library's: the text comes back but for U+2581, which reads as a blank.

A task holds the known words of one part at a time and answers the rows of that part; the answers go back to their chunks,
where a task reads its chunk's range of the file and writes out the documents' ids.

Cases: null and empty texts have no ids; rows that repeat are encoded alike; equal scores prefer the shorter last piece,
then the greater id; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import keyed, shared_dir, written
from .words import give_back

MARK = "▁"
LONGEST, BLOCK = 48, 512
CHUNK = 16 << 20
UNKNOWN = -100.0


class Table:
    """The pieces of a model file: normal ones with scores, the first byte piece, and which neighbours a piece can hold."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.piece_size()
        self.byte = next((i for i in range(n) if model.is_byte(i)), None)
        if self.byte is not None and not all(model.is_byte(self.byte + k) for k in range(256)):
            raise ValueError("the byte pieces of this model don't follow each other")
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in normal}
        ranks = all(s == int(s) for s in scores.values())
        exact = lambda x: round(x * (1 << 20)) / (1 << 20)  # noqa: E731  sums are exact, so equal paths tie in any order
        self.rows = [(model.id_to_piece(i), i, exact(-math.log1p(-scores[i]) if ranks else scores[i])) for i in normal]
        if n >= NONE:
            raise ValueError(f"ids need 16 bits: {n} pieces")
        self.longest = max(len(p) for p, _, _ in self.rows)
        if self.longest > 63:
            raise ValueError(f"lengths need 6 bits: a piece has {self.longest} characters")
        by_begin: dict[str, set[int]] = {}
        for p, _, _ in self.rows:
            if len(p) > 1:
                by_begin.setdefault(p[:2], set()).add(len(p))
        #: The lengths above 1 of the pieces with each pair of first characters.
        self.lengths = sorted((k, sorted(v)) for k, v in by_begin.items())
        self.text = [b""] * n
        for p, i, _ in self.rows:
            self.text[i] = p.replace(MARK, " ").encode()
        if self.byte is not None:
            for k in range(256):
                self.text[self.byte + k] = bytes([k])
        self.text[self.unknown] = " ⁇ ".encode()
        self.crossed = np.zeros((5, 5), bool)
        for p, _, _ in self.rows:
            for a, b in zip(p[:-1], p[1:], strict=True):
                self.crossed[char_class(a), char_class(b)] = True


def char_class(c: str) -> int:
    """0 the mark, 1 a letter or what stands on one, 2 a digit, 3 white space or control, 4 any other."""
    kind = unicodedata.category(c)
    return 0 if c == MARK else 1 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if kind[0] in "ZC" else 4


@cache
def _classes() -> np.ndarray:
    """The class of every code point: category names are made once in a worker."""
    kinds = {k: char_class(c) for k, c in ((unicodedata.category(chr(k)), chr(k)) for k in range(0x110000) if chr(k) != MARK)}
    out = np.fromiter((kinds[unicodedata.category(chr(k))] for k in range(0x110000)), np.uint8, 0x110000)
    out[ord(MARK)] = 0
    return out


def cut(text: str, classes: np.ndarray, crossed: np.ndarray) -> list[str]:
    """The words of a text, the mark in front."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    kind = classes[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
    n = len(kind)
    begin = np.ones(n, bool)
    begin[1:] = ~crossed[kind[:-1], kind[1:]] | ((kind[1:] == 0) & (kind[:-1] != 0))
    at = np.flatnonzero(begin).tolist()
    return [marked[a:b] for a, b in zip(at, [*at[1:], n], strict=True)]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


#: A row with part -1 tells where a chunk is, the others hold its words of a part.
CHUNKS = "chunk long, part int, file string, offset long, length long, words binary"
_CHUNK_FIELDS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("words", pa.binary())])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all first bytes first: upper bytes of small numbers compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel() if data else np.zeros(0, np.uint32)


def _part(word: Column, parts: int) -> Column:
    return (F.crc32(F.encode(word, "UTF-8")) % parts).cast("int")


def _chunked(base: str, crossed: np.ndarray, chunk_bytes: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        classes = _classes()
        store, root = fs.FileSystem.from_uri(base)
        name, out, offset, made = f"{uuid.uuid4().hex}.chunks", None, 0, 0
        numbers, rows, size = _Numbers(), [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal out, offset, made
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            docs = pa.table(
                {
                    "_id": pa.array([x[0] for x in rows], pa.int64()),
                    "_th": pa.array([x[1] for x in rows], pa.int64()),
                    "doc_id": pa.array([x[2] for x in rows], pa.int64()),
                    "n": pa.array([len(x[3]) for x in rows], pa.int64()),
                }
            )
            flat = np.concatenate([x[3] for x in rows])
            rows.clear()
            frequent = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(numbers), np.uint32)  # frequent words get small numbers
            rank[frequent] = np.arange(len(numbers), dtype=np.uint32)
            words = pa.array(list(numbers), pa.string())
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in numbers), np.int32, len(numbers))
            order = pc.sort_indices(pa.table({"p": part, "w": words}), sort_keys=[("p", "ascending"), ("w", "ascending")]).to_numpy()
            slot = np.empty(len(numbers), np.uint32)
            slot[rank[order]] = np.arange(len(numbers), dtype=np.uint32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as writer:
                writer.write_table(docs)
            sections = [sink.getvalue().to_pybytes(), _planes(slot), _planes(rank[flat])]
            del flat, rank, slot
            packer = zstandard.ZstdCompressor(level=6).compressobj()
            lengths = b"".join(len(x).to_bytes(8, "little") for x in sections)
            data = b"".join([lengths, *map(packer.compress, sections), packer.flush()])
            del sections
            out.write(data)
            number = TaskContext.get().partitionId() << 16 | made
            told = [{"chunk": number, "part": -1, "file": f"{base}/{name}", "offset": offset, "length": len(data)}]
            some, at = np.unique(part[order], return_index=True)
            for p, a, b in zip(some.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                own = words.take(pa.array(order[a:b])).to_pylist()
                told.append({"chunk": number, "part": p, "words": zstandard.compress(" ".join(own).encode(), 3)})
            offset, made = offset + len(data), made + 1
            return pa.RecordBatch.from_pylist(told, _CHUNK_FIELDS)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("_id", "_th", "doc_id", "text")), strict=True):
                text = row[3].as_py() or ""
                words = cut(text, classes, crossed)
                rows.append((*(x.as_py() for x in row[:3]), np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                size += len(text) + 64
                if size > chunk_bytes:
                    yield chunk()
                    numbers, rows, size = _Numbers(), [], 0
                    give_back()
        if rows:
            yield chunk()
            numbers, rows = _Numbers(), []
        if out is not None:
            out.close()
        give_back()

    return run


def _split(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split(" ")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part: the distinct words of one part at a time."""
    part, held = None, set()

    def told() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.string())], names=["word"])

    for batch in batches:
        for p, data in zip(batch.column("part").to_pylist(), batch.column("words"), strict=True):
            if p != part:
                yield from told()
                part, held = p, set()
            held.update(_split(data.as_py()))
    yield from told()
    held.clear()
    give_back()


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part and chunk, known words (chunk null) first: chunk, part and the ids of each chunk's words.

    An answer holds the number of words, the number of ids of each (32 bits), and the ids (16 bits), compressed.
    """
    part, place, found = None, {}, []
    flat, first, size = (np.zeros(0, np.int64),) * 3

    for batch in batches:
        out = []
        for p, chunk, words, ids in zip(*(batch.column(c) for c in ("part", "chunk", "words", "ids")), strict=True):
            if p.as_py() != part:
                part, place, found, flat = p.as_py(), {}, [], None
            if not chunk.is_valid:
                place[words.as_py().decode()] = len(found)
                found.append(ids.as_py())
                continue
            if flat is None:
                size = np.array([len(x) for x in found], np.int64) // 2
                first = np.cumsum(size) - size
                flat, found = np.frombuffer(b"".join(found), ">u2").astype("<u2"), []
            own = _split(words.as_py())
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            n = size[at]
            total = np.concatenate([[0], np.cumsum(n)])
            took = flat[np.repeat(first[at] - total[:-1], n) + np.arange(total[-1])]
            out.append((chunk.as_py(), part, zstandard.compress(len(own).to_bytes(8, "little") + _planes(n) + took.tobytes(), 3)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "part", "ids"])
    place.clear()
    give_back()


#: An edge in one number: end (6 bits), start (6), cost in 2**-20 (30), id (16); a state likewise: cost, 63 - start, NONE - id.
NONE = 65535


def _edge(id_: Column, cost: Column) -> Column:
    place = F.shiftleft(F.col("e").cast("long"), 52).bitwiseOR(F.shiftleft(F.col("s").cast("long"), 46))
    return place.bitwiseOR(F.shiftleft(cost.cast("long"), 16)).bitwiseOR(id_.cast("long"))


def _bits(x: Column, at: int, n: int) -> Column:
    return F.shiftright(x, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def lattice(words: DataFrame, table: Table) -> DataFrame:
    """word, edges for each row of words (word): the packed edges, by end position."""
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, round(-s * (1 << 20))) for p, i, s in table.rows], "piece string, id int, cost long")
    lengths = spark.createDataFrame(table.lengths, "begin string, lengths array<int>")
    n = F.length("word")
    from_each = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    begun = from_each.withColumn("begin", F.substring(F.col("word"), F.col("i"), F.lit(2))).join(F.broadcast(lengths), "begin", "left")
    to_each = begun.select("word", "i", F.explode(F.concat(F.array(F.lit(1)), F.coalesce("lengths", F.array().cast("array<int>")))).alias("k")).where(F.col("i") + F.col("k") <= n + 1)
    parts = to_each.select("word", (F.col("i") - 1).alias("s"), (F.col("i") + F.col("k") - 1).alias("e"), F.substring("word", F.col("i"), F.col("k")).alias("piece"))
    met = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or e = s + 1")
    edge = _edge(F.coalesce("id", F.lit(NONE)), F.coalesce("cost", F.lit(round(-UNKNOWN * (1 << 20)))))
    return met.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def best_path(words: DataFrame, table: Table) -> DataFrame:
    """word, ids (big-endian 16-bit) for each row of words (word, edges): Viterbi over the edges by end position, then back.

    The fold holds the best of each finished position and that of the position at hand; every position has an edge. The
    least state has the least cost, then the latest start, then the greatest id.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("best"))

    def grown(acc: Column, x: Column) -> Column:
        e, s = _bits(x, 52, 6), _bits(x, 46, 6)
        same = acc["e"] == e
        before = F.when(acc["e"] == s, acc["best"]).otherwise(F.get(acc["done"], s.cast("int")))
        told = F.shiftleft(F.shiftright(before, 22) + _bits(x, 16, 30), 22) + F.shiftleft(F.lit(63).cast("long") - s, 16) + (F.lit(NONE).cast("long") - _bits(x, 0, 16))
        done = F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["best"])))
        return F.struct(done.alias("done"), e.alias("e"), F.when(same, F.least(acc["best"], told)).otherwise(told).alias("best"))

    best = words.select("word", F.aggregate("edges", start, grown, lambda acc: F.concat(acc["done"], F.array(acc["best"]))).alias("best"))
    two = lambda x: F.lpad(F.hex(x), 4, "0")

    def spelled(at: Column) -> Column:
        if table.byte is None:
            return two(F.lit(table.unknown))
        code = F.hex(F.encode(F.substring(F.col("word"), at + 1, F.lit(1)), "UTF-8"))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: two(F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + table.byte)), "")

    def back(acc: Column, _: Column) -> Column:
        state = F.get(F.col("best"), acc["at"])
        s, id_ = (F.lit(63).cast("long") - _bits(state, 16, 6)).cast("int"), F.lit(NONE).cast("long") - _bits(state, 0, 16)
        text = F.when(id_ == NONE, spelled(s)).otherwise(two(id_))
        return F.when(acc["at"] > 0, F.struct(s.alias("at"), F.concat(text, acc["text"]).alias("text"))).otherwise(acc)

    none = F.struct(F.length("word").alias("at"), F.lit("").alias("text"))
    path = F.aggregate(F.sequence(F.lit(1), F.length("word")), none, back, lambda acc: acc["text"])
    return best.select("word", F.unhex(path).alias("ids"))


def best_path_long(words: DataFrame, table: Table) -> DataFrame:
    """word, ids for each row of words (word, p: a number of its own) of any length.

    A packed edge holds the end's place in its block (1 to BLOCK) and the piece's length; a state the cost, the length and
    NONE - id, which orders states of one end as `best_path` does. Costs run on from the least of the states at hand.
    """
    back_by, reach = table.longest - 1, F.lit(table.longest).cast("long")
    pieces = words.sparkSession.createDataFrame([(p, i, round(-s * (1 << 20))) for p, i, s in table.rows], "piece string, id int, cost long")
    n = F.length("word")
    blocks = words.select("p", "word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).alias("b"))
    first = F.greatest(F.col("b") - back_by, F.lit(0))
    m = F.least(F.lit(BLOCK), F.col("n") - F.col("b"))
    texts = blocks.select("p", "b", m.alias("m"), (F.col("b") - first).alias("before"), F.substring(F.col("word"), first + 1, F.col("b") - first + m).alias("text"))
    ends = texts.select("p", "b", "before", "text", F.explode(F.sequence(F.lit(1), "m")).alias("e"))
    reached = F.least(F.lit(table.longest), F.col("e") + F.col("before"))
    parts = ends.select("p", "b", "before", "text", "e", F.explode(F.sequence(F.lit(1), reached)).alias("s"))
    parts = parts.select("p", "b", "e", "s", F.substring(F.col("text"), F.col("before") + F.col("e") - F.col("s") + 1, F.col("s")).alias("piece"))
    met = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or s = 1")
    edge = _edge(F.coalesce("id", F.lit(NONE)), F.coalesce("cost", F.lit(round(-UNKNOWN * (1 << 20)))))
    edges = met.groupBy("p", "b").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    whole = edges.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("b", "edges"))).alias("blocks"))

    def grown(acc: Column, x: Column) -> Column:
        e, length = _bits(x, 52, 11), _bits(x, 46, 6)
        same = acc["e"] == e
        done = F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["best"])))
        before = F.get(done, (reach - 1 + e - length).cast("int"))
        told = F.shiftleft(F.shiftright(before, 22) + _bits(x, 16, 30), 22) + F.shiftleft(length, 16) + (F.lit(NONE).cast("long") - _bits(x, 0, 16))
        return F.struct(done.alias("done"), e.alias("e"), F.when(same, F.least(acc["best"], told)).otherwise(told).alias("best"))

    def block(acc: Column, x: Column) -> Column:
        tail = acc["tail"]
        start = F.struct(F.slice(tail, 1, back_by).alias("done"), F.lit(0).cast("long").alias("e"), F.element_at(tail, -1).alias("best"))

        def finished(last: Column) -> Column:
            states = F.concat(last["done"], F.array(last["best"]))
            kept = F.slice(states, -table.longest, table.longest)
            least = F.shiftright(F.array_min(kept), 22)
            made = F.slice(states, table.longest + 1, F.lit(BLOCK))
            return F.struct(F.concat(acc["made"], F.array(made)).alias("made"), F.transform(kept, lambda k: F.shiftleft(F.shiftright(k, 22) - least, 22)).alias("tail"))

        return F.aggregate(x["edges"], start, grown, finished)

    # positions before the word are never asked for; their cost is the most, so that it is not the least of the first tail
    tail = F.concat(F.array_repeat(F.lit(1 << 62), back_by), F.array(F.lit(0).cast("long")))
    none = F.struct(F.array().cast("array<array<bigint>>").alias("made"), tail.alias("tail"))
    best = whole.select("p", F.aggregate("blocks", none, block, lambda acc: F.flatten(acc["made"])).alias("best"))
    rows = best.join(words, "p").select("word", "best", F.split("word", "").alias("chars"))
    two = lambda x: F.lpad(F.hex(x), 4, "0")

    def spelled(at: Column) -> Column:
        if table.byte is None:
            return two(F.lit(table.unknown))
        code = F.hex(F.encode(F.get("chars", at), "UTF-8"))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: two(F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + table.byte)), "")

    def back(acc: Column, _: Column) -> Column:
        state = F.get(F.col("best"), acc["at"] - 1)
        s, id_ = acc["at"] - _bits(state, 16, 6).cast("int"), F.lit(NONE).cast("long") - _bits(state, 0, 16)
        text = F.concat(F.when(id_ == NONE, spelled(s)).otherwise(two(id_)), acc["text"])
        full = F.octet_length(acc["text"]) > 4 * BLOCK  # texts are put by, so that a step copies a short one only
        by = F.struct(s.alias("at"), F.when(id_ == NONE, spelled(s)).otherwise(two(id_)).alias("text"), F.concat(F.array(acc["text"]), acc["parts"]).alias("parts"))
        return F.when(acc["at"] <= 0, acc).when(full, by).otherwise(F.struct(s.alias("at"), text.alias("text"), acc["parts"].alias("parts")))

    start = F.struct(F.size("best").alias("at"), F.lit("").alias("text"), F.array().cast("array<string>").alias("parts"))
    path = F.aggregate(F.sequence(F.lit(1), F.size("best")), start, back, lambda acc: F.concat(acc["text"], F.array_join(acc["parts"], "")))
    return rows.select("word", F.unhex(path).alias("ids"))


def _assembled(texts: list[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        made = _documents(batches)
        yield from made if texts is None else _decoded(texts)(made)
        give_back()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            told = [zstandard.decompress(x["ids"].as_py()) for x in batch.column("told")[k].values or ()]
            store, path = fs.FileSystem.from_uri(batch.column("file")[k].as_py())
            with store.open_input_file(path) as f:
                data = f.read_at(batch.column("length")[k].as_py(), batch.column("offset")[k].as_py())
            lengths = [int.from_bytes(data[a : a + 8], "little") for a in (0, 8, 16)]
            data = zstandard.decompress(data[24:], sum(lengths))
            docs = pa.ipc.open_stream(data[: lengths[0]]).read_all().combine_chunks()
            slot = _from_planes(data[lengths[0] : lengths[0] + lengths[1]])
            numbers = _from_planes(data[lengths[0] + lengths[1] :])
            ends = [8 + 4 * int.from_bytes(x[:8], "little") for x in told]
            sizes = np.concatenate([_from_planes(x[8:e]) for x, e in zip(told, ends, strict=True)] or [np.zeros(0, np.uint32)]).astype(np.int64)
            flat = np.concatenate([np.frombuffer(x, "<u2", offset=e) for x, e in zip(told, ends, strict=True)] or [np.zeros(0, np.uint16)])
            del told
            bound = np.concatenate([[0], np.cumsum(sizes)])[slot]
            sizes = sizes[slot]
            cuts = np.concatenate([[0], np.cumsum(docs["n"].to_numpy())]).astype(np.int64)
            a = 0
            while a < docs.num_rows:  # some documents at a time
                b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + 200_000, side="right")) - 1)
                own = numbers[cuts[a] : cuts[b]]
                n = sizes[own]
                total = np.concatenate([[0], np.cumsum(n)])
                out = flat[np.repeat(bound[own] - total[:-1], n) + np.arange(total[-1])]
                ends = total[cuts[a : b + 1] - cuts[a]]
                part = docs.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(part[c].to_numpy(zero_copy_only=False), pa.int64(), from_pandas=True) if c != "doc_id" else part[c].combine_chunks() for c in ("_id", "_th", "doc_id")),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.astype(np.int32))),
                    ],
                    names=["_id", "_th", "doc_id", "ids"],
                )
                a = b


def encode(docs: DataFrame, table: Table, decoded: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """_id, _th, doc_id, ids for each row of docs (doc_id, text); with `decoded` also the text that the ids give, in the same task.

    chunk_bytes: text of a chunk. Larger chunks shuffle fewer words, smaller ones take less memory; the ids don't depend on it.
    """
    rows = keyed(docs).select("_id", "_th", "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = written(rows.mapInArrow(_chunked(shared_dir(docs.sparkSession), table.crossed, chunk_bytes, parts), CHUNKS), compression="zstd")
    asked = told.where("part >= 0").select("chunk", "part", "words")
    # a word has one part and a part one task, so these are distinct over all chunks
    distinct = written(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_distinct, "word string"), compression="zstd")
    known = best_path(lattice(distinct.where(F.length("word") <= LONGEST).repartition(parts, "word"), table), table)
    longer = written(distinct.where(F.length("word") > LONGEST).select(F.monotonically_increasing_id().alias("p"), "word"))
    known = known.unionByName(best_path_long(longer, table))
    known = known.select(_part(F.col("word"), parts).alias("part"), F.lit(None).cast("long").alias("chunk"), F.encode("word", "UTF-8").alias("words"), "ids")
    both = known.unionByName(asked.select("part", "chunk", "words", F.lit(None).cast("binary").alias("ids")))
    answers = both.repartition(parts, "part").sortWithinPartitions("part", F.col("chunk").asc_nulls_first()).mapInArrow(_answered, "chunk long, part int, ids binary")
    answers = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("told"))
    chunks = told.where("part < 0").select("chunk", "file", "offset", "length").repartition(parts, "chunk")
    back = chunks.join(answers.hint("merge"), "chunk", "left").select("file", "offset", "length", "told")
    return back.mapInArrow(_assembled(table.text if decoded else None), "_id long, _th long, doc_id long, ids array<int>" + ", text string" * decoded)


def _decoded(texts: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        bound = np.concatenate([[0], np.cumsum(sizes)])
        for batch in batches:
            ids = batch.column("ids")
            own = np.asarray(ids.flatten())
            lengths = np.asarray(ids.value_lengths())
            cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            out, a = [], 0
            while a < len(lengths):
                b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + 200_000, side="right")) - 1)
                part = own[cuts[a] : cuts[b]]
                n = sizes[part]
                total = np.concatenate([[0], np.cumsum(n)])
                data = flat[np.repeat(bound[part] - total[:-1], n) + np.arange(total[-1])].tobytes()
                ends = total[cuts[a : b + 1] - cuts[a]].tolist()
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    text = data[x:y]
                    out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
                a = b
            kept = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string())], names=[*batch.schema.names, "text"])

    return run


def decode(encoded: DataFrame, table: Table) -> DataFrame:
    """encoded (with ids: array<int>) and the text."""
    return encoded.mapInArrow(_decoded(table.text), StructType([*encoded.schema.fields, StructField("text", StringType())]))


def load(path: str) -> Table:
    return Table(path)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids: doc_id, n_tokens, ids_crc32 (of the ids in decimal, joined by commas), decoded_equal."""
    import public_tokenizers

    table = load(public_tokenizers.path("piece_bpe_32k.model"))
    back = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), table, decoded=True)
    equal = (F.xxhash64("text", F.col("doc_id").isNull()) == F.col("_th")) | ((F.size("ids") == 0) & (F.col("text") == ""))
    code = F.crc32(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), code.alias("ids_crc32"), equal.alias("decoded_equal"))
