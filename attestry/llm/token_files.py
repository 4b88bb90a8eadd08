"""Token ids in a compressed binary format, readable in parallel.

Encoding. Texts are cut where no pre-token goes on (before blanks, between letters, digits and other signs), and the pieces
made distinct by Arrow, some MB at a time; each distinct piece that a Python worker meets is encoded once by the tokenizers
library and looked up afterwards. Texts where that could differ (odd white space, a special token's string) are encoded by
the library whole.

Format. The ids of all documents, each ended by END, form one stream in ascending doc_id order. It is cut into blocks of
whole documents, about BLOCK ids each (a larger document is a block). A folder holds two Parquet tables and needs nothing
else to be read. `blocks` has a row for each block: its first id's place in the stream, the doc_ids and lengths, the
number of ids, a CRC-32 of the ids, checkpoints, and a payload. `frequencies` is the table that all blocks share: id and
frequency, 2**BITS in all, made from the ids of all documents (2**16 rows at most, whatever the input's size).

A payload is a static range asymmetric numeral system with LANES interleaved 64-bit states, which emit 32-bit words. A
checkpoint every STRIDE steps holds the states and the place in the payload, so that decoding can begin there
(`read_range` does). Blocks don't depend on each other: any subset can be decoded anywhere.

Cases: a null or empty text is the end id alone; rows with one doc_id stand after each other in order of their texts'
hash; a null doc_id comes first; further columns are ignored; no rows give no blocks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keyed, shared_dir, written
from .words import slices, text_bytes

END = 2
LANES = 1024
BITS = 20
BLOCK = 1 << 19
STRIDE = 256
#: Pieces that a Python worker remembers, over all tasks that it runs; and 16 times as many ids.
MEMORY = 1_200_000
#: New pieces that the library gets as one text; with many more it takes longer for each.
JOINT = 200
#: White space beyond ASCII's, or a blank that has white space on both sides or ends the text after some.
ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \t\n\r\x0b\x0c] (?:[ \t\n\r\x0b\x0c]|\z)"
#: Text that is cut and numbered at once.
PART = 4 << 20


def _cuts() -> tuple[np.ndarray, np.ndarray]:
    """A kind for each byte, and whether a text is cut between two kinds (kind of the first * 8 + kind of the second).

    Kinds: 1 letter, 2 digit, 3 other sign, 4 apostrophe, 5 white space, 6 blank, 0 bytes beyond ASCII.
    """
    kind = np.zeros(256, np.uint8)
    kind[:128] = 3
    for k, some in ((1, range(65, 91)), (1, range(97, 123)), (2, range(48, 58)), (4, b"'"), (5, b"\t\n\x0b\x0c\r"), (6, b" ")):
        kind[list(some)] = k
    cut = np.zeros((8, 8), bool)
    cut[:, 6] = True
    cut[1, [2, 3, 4, 5]] = cut[2, [1, 3, 4, 5]] = cut[3, [1, 2]] = True
    return kind, cut.ravel()


KIND, CUT = _cuts()


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and the number of each text's first (one more for the end)."""
    raw, bounds = text_bytes(texts)
    kind = KIND[raw]
    if raw.size and raw.max() > 127:
        latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
        latin = latin[(raw[latin] != 0x97) & (raw[latin] != 0xB7)]
        kind[latin] = kind[latin - 1] = 1
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = CUT[kind[:-1] << 3 | kind[1:]]
        line = np.flatnonzero(kind[1:-1] == 5) + 1
        cut[line[(raw[line - 1] > 32) & (raw[line + 1] > 32)] + 1] = True
    cut[bounds] = True
    at = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
    return pieces, np.searchsorted(at, bounds)


class Encoder:
    """Texts to ids, with a memory of pieces that are encoded alike wherever they stand.

    Byte-level pre-tokens are letters, digits or other signs, with one blank on their left, an apostrophe with some letters,
    or white space. So none goes on over a blank, from a letter or digit to another ASCII kind, or from another sign than an
    apostrophe to a letter or digit; nor from one white-space character between two others to the second. (A letter is an
    ASCII one or one of U+00C0 to U+00FF; elsewhere beyond ASCII only blanks and lines part.) That doesn't hold where a run of
    white space holds a blank that isn't its last character and isn't its first one. Those texts are ODD; the library
    encodes them whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need 16 bits")
        self.bytes = np.zeros(1 << 16, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joint(self, pieces: np.ndarray, length: np.ndarray, between: str) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """For every JOINT pieces in one text their ids and how many each has, by the bytes of the tokens; None where a token joins two."""
        for a in range(0, len(pieces), JOINT * 64):
            firsts = range(a, min(a + JOINT * 64, len(pieces)), JOINT)
            for k, ids in zip(firsts, self._encode([between.join(pieces[k : k + JOINT]) for k in firsts]), strict=True):
                ends = np.cumsum(length[k : k + JOINT] + len(between))
                reached = np.cumsum(self.bytes[ids])
                if between:
                    reached, ids = np.append(reached, reached[-1] + 1), np.append(ids, np.uint16(END))
                last = np.searchsorted(reached, ends)
                fits = last[-1] == len(ids) - 1 and (reached[last] == ends).all()
                if between and fits:
                    fits = (reached[last - 1] == ends - 1).all()
                    ids = np.delete(ids, last)
                    last -= np.arange(1, len(last) + 1)
                yield (ids, np.diff(last, prepend=-1)) if fits else None

    def _learn(self, pieces: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Remembers new pieces and returns their places. Those of groups 0 (with a blank) and 1 (without) go many in one text, others alone."""
        order, flat, sizes, rest = [], [self.flat], [], [np.flatnonzero(group == 2)]
        for g, between in enumerate(("", "\n")):
            own = np.flatnonzero(group == g)
            for k, found in enumerate(self._joint(pieces[own], length[own], between)):
                some = own[k * JOINT : (k + 1) * JOINT]
                if found is None:
                    rest.append(some)
                else:
                    order.append(some)
                    flat.append(found[0])
                    sizes.append(found[1])
        order += rest
        each = self._encode(pieces[np.concatenate(rest)].tolist())
        sizes.append(np.array([len(x) for x in each], np.int64))
        self.flat = np.concatenate([*flat, *each])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        order = np.concatenate(order)
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(self.place), len(self.place) + len(pieces))
        self.place.update(zip(pieces.tolist(), place.tolist(), strict=True))
        return place

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and where each text's begin (one more for the end); null is empty."""
        if len(self.place) > MEMORY or len(self.flat) > 16 * MEMORY:
            self._forget()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, ODD)
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        pieces, begin = _pieces(pc.if_else(whole, "", texts) if odd else texts)
        pieces = pieces.dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.place.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(place < 0)
        if len(new):
            raw, bounds = text_bytes(pieces.dictionary.take(pa.array(new)))
            length = np.diff(bounds)
            first, second, last = raw[bounds[:-1]], raw[np.minimum(bounds[:-1] + 1, len(raw) - 1)], raw[bounds[1:] - 1]
            group = np.where(last <= 32, 2, np.where(first > 32, 1, np.where((first == 32) & (second > 32), 0, 2)))
            place[new] = self._learn(own[new], length, group)
        known = pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(2 * self.ends), pa.py_buffer(self.flat)])
        _, reached, data = known.take(pa.array(place)).take(pieces.indices).buffers()
        bound = np.frombuffer(reached, np.int64, len(pieces) + 1)[begin] // 2
        ids = np.frombuffer(data, np.uint16, bound[-1]) if bound[-1] else np.zeros(0, np.uint16)
        if odd:
            parts = [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
            for k, x in zip(odd, self._encode(texts.take(pa.array(odd)).to_pylist()), strict=True):
                parts[k] = x
            ids, bound = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bound


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


RAW = "part int, start long, n long, doc_ids array<long>, lengths array<long>, ids binary"


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        part, start, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            lengths = [len(x) for _, x in held]
            row = [part, start, size, [d for d, _ in held], lengths, np.concatenate([x for _, x in held]).astype("<u2", copy=False).tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in RAW.split(", ")])

        for batch in batches:
            for own in slices(batch, most=PART):
                ids, bound = encoder.ids(own.column("text"))
                ids, bound = np.insert(ids, bound[1:], END), bound + np.arange(len(bound))
                for doc, a, b in zip(own.column("doc_id").to_pylist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    if held and size + b - a > BLOCK:
                        yield block()
                        start, held, size = start + size, [], 0
                    held.append((doc, ids[a:b]))
                    size += b - a
        if held:
            yield block()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("ids"):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])


def shared_table(counts: dict[int, int]) -> np.ndarray:
    """Frequencies of 2**16 ids: at least 1 for each id that occurs, 2**BITS in all."""
    n = np.zeros(1 << 16, np.int64)
    for k, v in counts.items():
        n[k] = v
    out = np.where(n > 0, np.maximum(1, n * float((1 << BITS) - (n > 0).sum()) // max(1, n.sum())), 0).astype(np.int64)
    if n.any():
        out[n.argmax()] += (1 << BITS) - out.sum()
    return out


def rans_encode(ids: np.ndarray, table: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
    """Payload, and the states and payload places of the checkpoints (the first is the start of decoding).

    Words are emitted backwards, so a decoder reads forwards. Id k of the block belongs to lane k mod LANES.
    """
    begin = np.concatenate([[0], np.cumsum(table)])[:-1].astype(np.uint64)
    freq = table.astype(np.uint64)
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, 1 << 31, np.uint64)
    words: list[np.ndarray] = []
    emitted = 0
    marks: list[tuple[int, bytes]] = []
    low, shift, mask = np.uint64(32), np.uint64(BITS), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        own = ids[step * LANES : (step + 1) * LANES]
        live = state[: len(own)]
        f = freq[own]
        full = live >= (f << np.uint64(63 - BITS))
        if full.any():
            words.append((live[full] & mask).astype("<u4")[::-1])
            emitted += len(words[-1])
            live[full] >>= low
        q, r = np.divmod(live, f)
        state[: len(own)] = (q << shift) + r + begin[own]
        if step % STRIDE == 0:
            marks.append((emitted, state.astype("<u8").tobytes()))
    payload = np.concatenate(words)[::-1].tobytes() if words else b""
    marks.reverse()
    return payload, [s for _, s in marks], [emitted - at for at, _ in marks]


def rans_decode(payload: bytes, states: list[bytes], places: list[int], n: int, table: np.ndarray, slots: np.ndarray, since: int = 0, until: int | None = None) -> np.ndarray:
    """The block's ids from checkpoint `since` on, before place `until`. slots: the id of each of the 2**BITS slots."""
    begin = np.concatenate([[0], np.cumsum(table)])[:-1].astype(np.uint64)
    freq = table.astype(np.uint64)
    words = np.frombuffer(payload, "<u4").astype(np.uint64)
    state = np.frombuffer(states[since], "<u8").astype(np.uint64)
    at, first = places[since], since * STRIDE
    out = np.empty((n if until is None else until) - first * LANES, np.uint16)
    mask, shift, low, least = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(1 << 31)
    for base in range(0, len(out), LANES):
        m = min(LANES, len(out) - base)
        live = state[:m]
        slot = live & mask
        own = slots[slot.astype(np.int64)]
        out[base : base + m] = own
        live[:] = freq[own] * (live >> shift) + slot - begin[own]
        short = np.flatnonzero(live < least)
        if len(short):
            live[short] = (live[short] << low) | words[at : at + len(short)]
            at += len(short)
    return out


BLOCKS = "start long, n long, doc_ids array<long>, lengths array<long>, crc long, states array<binary>, places array<int>, payload binary"


def _blocks(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column("ids")):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                payload, states, places = rans_encode(ids, table)
                made = {
                    "crc": pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()),
                    "states": pa.array([states], pa.list_(pa.binary())),
                    "places": pa.array([places], pa.list_(pa.int32())),
                    "payload": pa.array([payload], pa.binary()),
                }
                kept = {c: batch.column(c).slice(k, 1) for c in ("start", "n", "doc_ids", "lengths")}
                yield pa.RecordBatch.from_pydict(kept | made)

    return run


def _decoded(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.repeat(np.arange(len(table), dtype=np.uint16), table)
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ids = rans_decode(x["payload"], x["states"], x["places"], x["n"], table, slots)
                wide = ids.astype("<u4")
                if zlib.crc32(wide.tobytes()) != x["crc"]:
                    raise ValueError(f"the checksum of the block at {x['start']} differs")
                bound = np.concatenate([[0], np.cumsum(x["lengths"])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x["doc_ids"], pa.int64()),
                        pa.array(bound[:-1] + x["start"]),
                        pa.array(np.diff(bound)),
                        pa.array([wide[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of ids not yet compressed (RAW), as a written table.

    Texts are range-partitioned by doc_id and sorted; a block's start counts from the beginning of its range.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_th")]
    rows = keyed(docs).select("doc_id", "_th", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("doc_id", "text").mapInArrow(_encoded(path), RAW), compression="zstd")


def _decoded_from(table: np.ndarray, first: int, count: int):
    """Of each block the ids whose places in the stream are in [first, first + count), from the checkpoint before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.repeat(np.arange(len(table), dtype=np.uint16), table)
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in ("payload", "states", "places", "n", "start")}
                a, b = max(first - x["start"], 0), min(first + count - x["start"], x["n"])
                since = a // (STRIDE * LANES)
                ids = rans_decode(x["payload"], x["states"], x["places"], x["n"], table, slots, since, b)[a - since * STRIDE * LANES :]
                yield pa.RecordBatch.from_arrays([pa.array([x["start"] + a]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return run


def write_files(raw: DataFrame, path: str) -> None:
    """Writes the folder: the frequencies of all ids, then the blocks, with their places in the stream.

    A range's place in the stream is the total of those before it: one row for each shuffle partition, broadcast.
    """
    spark = raw.sparkSession
    counts = raw.select("ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = shared_table({r.id: r.n for r in counts.collect()})
    used = np.flatnonzero(table).tolist()
    spark.createDataFrame([(k, int(table[k])) for k in used], "id int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = raw.groupBy("part").agg(F.sum("n").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    placed = raw.join(F.broadcast(bases), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")
    placed.mapInArrow(_blocks(table), BLOCKS).write.parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    table = np.zeros(1 << 16, np.int64)
    for r in spark.read.schema("id int, frequency long").parquet(f"{path}/frequencies").collect():
        table[r.id] = r.frequency
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), table


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from a folder, each block checked against its checksum."""
    blocks, table = _opened(spark, path)
    return blocks.mapInArrow(_decoded(table), "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """start, ids: the ids at places first to first + count - 1 of the stream, a row for each block that holds some.

    Only those blocks are read, each from the last checkpoint before its first id asked for (without a checksum).
    """
    blocks, table = _opened(spark, path)
    asked = blocks.where((F.col("start") < first + count) & (F.col("start") + F.col("n") > first)).select("start", "n", "states", "places", "payload")
    return asked.mapInArrow(_decoded_from(table, first, count), "start long, ids array<int>")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_files(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
