"""Hash chains, Merkle commitments and workflow graphs.

Link checks join each receipt with the one a height below it by (tenant, height), which spreads a large tenant evenly
where a window would sort it in one task. Merkle work is cut into aligned blocks of BLOCK leaves: a task reads one block,
and the blocks' roots go through the same step again, so no task sees a whole tree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from attestry.functions.canonical import body_hash
from attestry.functions.signatures import sign_all, valid_all
from attestry.functions.tables import lookup, written

ZERO = "0" * 64
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS


def verify_links(rows: DataFrame) -> DataFrame:
    """receipt_id, tenant_id, chain_height, link_ok: the stated previous hash is that of the height below; zeros at height 1."""
    slim = rows.select("receipt_id", "tenant_id", "chain_height", "receipt_hash", "previous_receipt_hash")
    below = slim.select("tenant_id", (F.col("chain_height") + 1).alias("chain_height"), F.col("receipt_hash").alias("_below"))
    joined = slim.join(below, ["tenant_id", "chain_height"], "left")
    first = (F.col("chain_height") == 1) & (F.col("previous_receipt_hash") == ZERO)
    ok = first | ((F.col("chain_height") > 1) & F.coalesce(F.col("previous_receipt_hash") == F.col("_below"), F.lit(False)))
    return joined.select("receipt_id", "tenant_id", "chain_height", ok.alias("link_ok"))


def store_receipts(rows: DataFrame, name: str, path: str, buckets: int = 8, heights: int = BLOCK) -> DataFrame:
    """rows as the table `name` at path: a folder a tenant, buckets of ranges of `heights` heights in it.

    The last receipt of a range is also kept with the next one (carried), so a range holds all that its links need: one
    tenant is read from its folder alone, and links are checked where the rows are (`verify_stored_links`).
    """
    at = lambda h: F.floor((h - 1) / heights).cast("long")
    own = rows.withColumn("range", at(F.col("chain_height"))).withColumn("carried", F.lit(False))
    ends = rows.where(F.col("chain_height") % heights == 0).withColumn("range", at(F.col("chain_height") + 1)).withColumn("carried", F.lit(True))
    dealt = own.unionByName(ends).repartition("tenant_id", F.pmod(F.hash("range"), F.lit(buckets)))
    dealt.write.partitionBy("tenant_id").bucketBy(buckets, "range").sortBy("range", "chain_height").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def verify_stored_links(stored: DataFrame) -> DataFrame:
    """verify_links over a table of store_receipts, without an exchange. Of receipts at one height the least by hash is the one below."""
    order = Window.partitionBy("tenant_id", "range").orderBy("chain_height").rangeBetween(-1, -1)
    below = F.min("receipt_hash").over(order)
    first = (F.col("chain_height") == 1) & (F.col("previous_receipt_hash") == ZERO)
    ok = first | ((F.col("chain_height") > 1) & F.coalesce(F.col("previous_receipt_hash") == F.col("_below"), F.lit(False)))
    return stored.withColumn("_below", below).where("not carried").select("receipt_id", "tenant_id", "chain_height", ok.alias("link_ok"))


def verify_chains(links: DataFrame) -> DataFrame:
    """Per tenant: length, whether it begins at height 1, first broken height, number of breaks, valid."""
    bad = ~F.col("link_ok")
    return links.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("length"),
        (F.min("chain_height") == 1).alias("complete"),
        F.min(F.when(bad, F.col("chain_height"))).alias("first_broken"),
        F.count_if(bad).alias("errors"),
        (F.count_if(bad) == 0).alias("valid"),
    )


def chain_gaps_forks(rows: DataFrame) -> DataFrame:
    """tenant_id, kind (fork or gap), from_height, to_height: heights held twice or more, and ranges of missing heights."""
    heights = rows.groupBy("tenant_id", "chain_height").agg(F.count(F.lit(1)).alias("n"))
    forks = heights.where("n > 1").select("tenant_id", F.lit("fork").alias("kind"), F.col("chain_height").alias("from_height"), F.col("chain_height").alias("to_height"))
    after = heights.select("tenant_id", (F.col("chain_height") - 1).alias("chain_height"), F.lit(True).alias("_next"))
    ends = heights.join(after, ["tenant_id", "chain_height"], "left").where("_next is null").select("tenant_id", "chain_height")
    before = heights.select("tenant_id", (F.col("chain_height") + 1).alias("chain_height"))
    starts = heights.join(before, ["tenant_id", "chain_height"], "left_anti").select("tenant_id", "chain_height")
    # a gap lies between an end of a run and the next start; runs are few, so a window over them is cheap
    edges = ends.withColumn("end", F.lit(True)).unionByName(starts.withColumn("end", F.lit(False)))
    nxt = F.lead("chain_height").over(Window.partitionBy("tenant_id").orderBy("chain_height", F.col("end").asc()))
    gaps = edges.withColumn("nxt", nxt).where("end and nxt is not null").select("tenant_id", F.lit("gap").alias("kind"), (F.col("chain_height") + 1).alias("from_height"), (F.col("nxt") - 1).alias("to_height"))
    return forks.unionByName(gaps)


def authoritative(rows: DataFrame) -> DataFrame:
    """Of receipts at one height of a tenant, that with the lower hash."""
    return rows.groupBy("tenant_id", "chain_height").agg(F.min("receipt_hash").alias("receipt_hash"))


def chain_heads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id").agg(F.max("chain_height").alias("chain_height"), F.max_by("receipt_hash", "chain_height").alias("receipt_hash"), F.max_by("receipt_id", "chain_height").alias("receipt_id"))


def pack_manifest(rows: DataFrame) -> DataFrame:
    """Per tenant and month: receipts, first and last height, head hash, policies used."""
    month = F.substring("captured_at", 1, 7).alias("period")
    policies = rows.select("tenant_id", month, F.explode("applied_policies").alias("p")).groupBy("tenant_id", "period").agg(F.concat_ws(",", F.sort_array(F.collect_set("p"))).alias("policies"))
    found = rows.groupBy("tenant_id", month).agg(F.count(F.lit(1)).alias("receipts"), F.min("chain_height").alias("first_height"), F.max("chain_height").alias("last_height"), F.max_by("receipt_hash", "chain_height").alias("head_hash"))
    return found.join(policies, ["tenant_id", "period"], "left").na.fill("", ["policies"])


def registry_history(entries: DataFrame) -> DataFrame:
    """id, version, current, link_ok from entries (id, version, entry_hash, previous_version_hash)."""
    own = Window.partitionBy("id").orderBy("version")
    last = F.lag("entry_hash").over(own)
    ok = F.when(last.isNull(), F.col("previous_version_hash").isNull()).otherwise(F.coalesce(F.col("previous_version_hash") == last, F.lit(False)))
    return entries.withColumn("link_ok", ok).withColumn("current", F.lead("version").over(own).isNull()).select("id", "version", "current", "link_ok")


def sign_receipts(rows: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """rows with signature (hex): Ed25519 over the bytes of receipt_hash with the seed (hex) of the row's kid; empty where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {k: bytes.fromhex(v) for k, v in seeds.items()}
        for b in batches:
            own = [k for k, kid in enumerate(b["kid"]) if kid in known]
            made = sign_all([known[b["kid"].iat[k]] for k in own], [bytes.fromhex(b["receipt_hash"].iat[k]) for k in own])
            signatures = [""] * len(b)
            for k, signature in zip(own, made, strict=True):
                signatures[k] = signature.hex()
            yield b.assign(signature=signatures)

    return rows.drop("signature").mapInPandas(run, StructType([*rows.drop("signature").schema.fields, StructField("signature", StringType())]))


def verify_pack(checks: DataFrame, by: tuple[str, ...] = ("tenant_id",), packs: DataFrame | None = None) -> DataFrame:
    """Per tenant (or the columns of by) of checks (tenant_id, hash_ok, signature_ok, included): receipts, failed ones, and whether none failed.

    packs: the columns of by, keyed (keys were supplied) and pack_hash_ok of each pack. Then a pack whose hash isn't that of
    its contents isn't valid either, the three checks of a pack have a column each, and without keys all of them fail: a
    pack can't vouch for itself. A pack that has lost all receipts is a row, as are receipts of no pack. `pack_failures`
    lists what failed, a row a receipt, as the list of a hot tenant would be one value.
    """
    signed, included = [F.coalesce(c, F.lit(False)) for c in (F.col("hash_ok") & F.col("signature_ok"), F.col("included"))]
    bad = ~(signed & included)
    found = checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("receipts"), F.count_if(bad).alias("failed"), (F.count_if(bad) == 0).alias("valid"), (F.count_if(~included) == 0).alias("all_receipts_included"), (F.count_if(~signed) == 0).alias("all_signatures_valid")
    )
    if packs is None:
        return found.select(*by, "receipts", "failed", "valid")
    held = lambda c: F.coalesce(F.col("keyed") & F.col(c), F.lit(False)).alias(c)
    tested = found.join(packs.withColumnRenamed("pack_hash_ok", "pack_hash_matches"), list(by), "full").na.fill(0, ["receipts", "failed"])
    tested = tested.select(*by, "receipts", "failed", held("valid"), held("pack_hash_matches"), held("all_receipts_included"), held("all_signatures_valid"))
    return tested.withColumn("valid", F.col("valid") & F.col("pack_hash_matches"))


def build_packs(envelopes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An evidence pack a tenant of whole envelopes (verify_envelopes) with idx, their place in the pack from 0: receipts, proofs, manifests.

    proofs: tenant_id, idx, size, node, path of each receipt's leaf, which is made of its hash. manifests: tenant_id,
    receipts, root, pack_hash. The hash is of the tenant, the number of receipts, the root, and all receipts and proofs.
    """
    receipts = written(envelopes, "zstd")
    made = written(merkle_proofs(receipts.select(F.col("tenant_id").alias("batch"), F.col("idx").cast("long").alias("idx"), leaf_hash(F.col("receipt_hash")).alias("node"))), "zstd")
    proofs = made.drop("root").withColumnRenamed("batch", "tenant_id")
    roots = made.groupBy(F.col("batch").alias("tenant_id")).agg(F.count(F.lit(1)).alias("receipts"), F.min("root").alias("root"))
    return receipts, proofs, written(_with_pack_hash(receipts, proofs, roots))


def _with_pack_hash(receipts: DataFrame, proofs: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (tenant_id, receipts, root) with pack_hash. Each receipt and proof is hashed as JSON of sorted names; hashes are folded by blocks, so no task sees a whole pack."""
    rows = None
    for part, df in (("proofs", proofs), ("receipts", receipts)):
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        own = df.select("tenant_id", F.lit(part).alias("part"), F.col("idx").cast("long").alias("idx"), F.sha2(text, 256).alias("hash"))
        rows = own if rows is None else rows.unionByName(own)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: F.concat_ws(":", x["idx"].cast("string"), x["hash"]))
    for _ in range(2):
        rows = rows.groupBy("tenant_id", "part", F.shiftright("idx", BLOCK_BITS).alias("block")).agg(F.sha2(F.concat_ws(",", listed), 256).alias("hash")).withColumnRenamed("block", "idx")
    parts = rows.groupBy("tenant_id", "part").agg(F.sha2(F.concat_ws(",", listed), 256).alias("hash"))
    whole = parts.groupBy("tenant_id").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "part", "hash")))).alias("contents"))
    return roots.join(whole, "tenant_id", "left").withColumn("pack_hash", F.sha2(F.concat_ws("|", "tenant_id", "receipts", "root", "contents"), 256)).drop("contents")


def pack_hash_checks(receipts: DataFrame, proofs: DataFrame, manifests: DataFrame) -> DataFrame:
    """tenant_id, pack_hash_ok: the hash of what the pack holds now is the one it states."""
    made = _with_pack_hash(receipts, proofs, manifests.select("tenant_id", "receipts", "root"))
    stated = manifests.select("tenant_id", F.col("pack_hash").alias("_stated"))
    return made.join(stated, "tenant_id").select("tenant_id", F.coalesce(F.col("pack_hash") == F.col("_stated"), F.lit(False)).alias("pack_hash_ok"))


def with_inclusion(checks: DataFrame, proofs: DataFrame, manifests: DataFrame) -> DataFrame:
    """checks (tenant_id, idx, leaf: leaf_hash of the receipt's hash, ...) with included: the pack's proof of this place leads from the leaf to the pack's root.

    A proof is followed where it lies, and its node is held against the receipt's leaf: paths aren't exchanged. A receipt without a proof isn't included.
    """
    followed = verify_inclusion(lookup(proofs, manifests.select("tenant_id", "root"), ["tenant_id"]))
    proved = followed.groupBy("tenant_id", "idx").agg(F.min(F.when(F.col("included"), F.lower("node"))).alias("_leaf"))
    included = F.coalesce(F.col("_leaf") == F.col("leaf"), F.lit(False))
    return checks.join(proved, ["tenant_id", "idx"], "left").withColumn("included", included).drop("_leaf")


def pack_failures(checks: DataFrame, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """tenant_id (or the columns of by), receipt_id, failed of checks (tenant_id, receipt_id, hash_ok, signature_ok, included): each receipt that fails, with all checks it fails, in order.

    A check without an answer fails, so a pack without keys lists every receipt.
    """
    names = (("body", "hash_ok"), ("inclusion", "included"), ("signature", "signature_ok"))
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(name)) for name, c in names]), lambda x: x.isNotNull())
    return checks.select(*by, "receipt_id", F.array_join(failed, ",").alias("failed")).where("failed <> ''")


def _holding(known: dict[str, bytes], hashes: list, kids: list, signatures: list) -> list[bool]:
    """Whether each signature (hex) holds over its hash (hex) under the key of its kid; what is malformed doesn't."""
    out, ready = [False] * len(hashes), []
    for k, (h, kid, signature) in enumerate(zip(hashes, kids, signatures, strict=True)):
        if kid in known:
            try:
                ready.append((k, known[kid], bytes.fromhex(h), bytes.fromhex(signature)))
            except (TypeError, ValueError):
                pass
    for (k, *_), ok in zip(ready, valid_all([r[1] for r in ready], [r[2] for r in ready], [r[3] for r in ready]), strict=True):
        out[k] = ok
    return out


def _hashed(texts: pd.Series, hashes: pd.Series) -> list[bool]:
    """Whether each JSON text has the stated hash."""
    return [t is not None and (made := body_hash(t)) is not None and made == h for t, h in zip(texts, hashes, strict=True)]


def verify_receipts(rows: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """receipt_id, hash_ok, signature_ok of rows (receipt_id, raw: JSON text of the body, receipt_hash, kid, signature: hex).

    keys: public keys in hex by kid. A malformed text or signature is a failed check, never a failed job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {k: bytes.fromhex(v) for k, v in (keys or {}).items()}
        for b in batches:
            signed = _holding(known, b["receipt_hash"].tolist(), b["kid"].tolist(), b["signature"].tolist())
            yield pd.DataFrame({"receipt_id": b["receipt_id"], "hash_ok": _hashed(b["raw"], b["receipt_hash"]), "signature_ok": signed})

    return rows.select("receipt_id", "raw", "receipt_hash", "kid", "signature").mapInPandas(run, "receipt_id string, hash_ok boolean, signature_ok boolean")


_CHECKS = ["envelope_ok", "hash_ok", "signature_ok", "genesis_ok", "imprint_ok"]


def verify_envelopes(rows: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """receipt_id, envelope_ok, hash_ok, signature_ok, genesis_ok, imprint_ok, valid, errors for whole envelopes.

    rows: receipt_id, chain_height, previous_receipt_hash, receipt_hash, raw (JSON text of the body), signatures (array of
    kid, alg, sig: hex), timestamps (array of imprint: hex). An envelope needs an id, a body, a hash of 64 hex digits, a
    height of 1 or more and a signature; its body must have the stated hash; one signature at least must be an EdDSA one
    of a known kid that holds; at height 1 the previous hash is zeros, and nowhere else; each time stamp's imprint is the
    receipt's hash. A null check fails. errors: the names of the checks that fail, in this order.
    """
    out = envelope_checks(rows, {"": keys}).select("receipt_id", *_CHECKS)
    errors = F.concat_ws(",", *[F.when(~F.col(n), n.removesuffix("_ok")) for n in _CHECKS])
    return out.withColumn("errors", errors).withColumn("valid", F.col("errors") == "")


def envelope_checks(rows: DataFrame, sets: dict[str, dict[str, str] | None], carried: tuple[str, ...] = ()) -> DataFrame:
    """receipt_id, the carried columns and the five checks of verify_envelopes under each set of keys, which `keys` names.

    One pass: a row is hashed once and nothing is exchanged, whatever the number of sets and signatures.
    """
    hex64 = "^[0-9a-f]{64}$"
    envelope = F.col("receipt_id").isNotNull() & F.col("raw").isNotNull() & F.col("receipt_hash").rlike(hex64) & F.col("previous_receipt_hash").rlike(hex64) & (F.col("chain_height") >= 1) & (F.size("signatures") > 0)
    genesis = (F.col("chain_height") == 1) == (F.col("previous_receipt_hash") == ZERO)
    imprint = F.forall(F.coalesce("timestamps", F.array().cast("array<struct<imprint:string>>")), lambda t: F.coalesce(t["imprint"] == F.col("receipt_hash"), F.lit(False)))
    flags = {"envelope_ok": envelope, "genesis_ok": genesis, "imprint_ok": imprint}
    each = rows.select(
        "receipt_id", *carried, *[F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()], "raw", "receipt_hash",
        F.transform("signatures", lambda s: F.when(s["alg"] == "EdDSA", s["kid"])).alias("_kids"), F.transform("signatures", lambda s: s["sig"]).alias("_signed"),
    )
    kept = ["receipt_id", *carried, *flags]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {name: {k: bytes.fromhex(v) for k, v in (keys or {}).items()} for name, keys in sets.items()}
        for b in batches:
            one = [(k, kid, s) for k, (kids, signed) in enumerate(zip(b["_kids"], b["_signed"], strict=True)) if kids is not None for kid, s in zip(kids, signed, strict=True)]
            hashes = b["receipt_hash"].tolist()
            hashed = [ok and i is not None for ok, i in zip(_hashed(b["raw"], b["receipt_hash"]), b["receipt_id"], strict=True)]
            for name in known:
                held = _holding(known[name], [hashes[k] for k, *_ in one], [kid for _, kid, _ in one], [s for *_, s in one])
                good = {k for (k, *_), ok in zip(one, held, strict=True) if ok}
                yield b[kept].assign(keys=name, hash_ok=hashed, signature_ok=[k in good and i is not None for k, i in enumerate(b["receipt_id"])])

    return each.mapInPandas(run, StructType([*each.select(*kept).schema.fields, *[StructField(n, t) for n, t in (("keys", StringType()), ("hash_ok", BooleanType()), ("signature_ok", BooleanType()))]]))


def seal_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """tenant_id, event_id, chain_height, previous_hash, receipt_hash of events (tenant_id, event_id, ts, body: JSON text).

    heads: tenant_id, chain_height, receipt_hash of chains that go on; others begin at height 1 with zeros. Bodies are made
    canonical and hashed in parallel; only 32-byte hashes go through the link of a tenant, which is one after another by
    its nature: hash(height) = SHA-256(hash(height - 1) | height | body hash). Tenants are sorted by Spark, which spills,
    and read as a stream that keeps the last hash alone, so a tenant of any size takes no memory.
    """
    columns = "tenant_id string, event_id long, ts timestamp_ntz, body string"

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(body=[body_hash(t) or hashlib.sha256((t or "").encode()).hexdigest() for t in b["body"]])

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, height, last = None, 0, ZERO
        for b in batches:
            out = []
            for own, event, at, body in zip(b["tenant_id"], b["event_id"], b["height"], b["body"], strict=True):
                if own != tenant:
                    tenant, height, last = own, 0, ZERO
                if at > 0:  # the head of a chain that goes on comes first
                    height, last = int(at), body
                    continue
                height += 1
                made = hashlib.sha256(f"{last}|{height}|{body}".encode()).hexdigest()
                out.append((own, event, height, last, made))
                last = made
            yield pd.DataFrame(out, columns=["tenant_id", "event_id", "chain_height", "previous_hash", "receipt_hash"])

    slim = events.select("tenant_id", "event_id", "ts", "body").mapInPandas(hashed, columns).withColumn("height", F.lit(0).cast("long"))
    if heads is not None:
        known = heads.select("tenant_id", F.lit(0).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("receipt_hash").alias("body"), F.col("chain_height").cast("long").alias("height"))
        slim = slim.unionByName(known)
    dealt = slim.repartition("tenant_id").sortWithinPartitions("tenant_id", F.desc("height"), "ts", "event_id")
    return dealt.mapInPandas(linked, "tenant_id string, event_id long, chain_height long, previous_hash string, receipt_hash string")


def _pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def leaf_hash(data: Column) -> Column:
    """SHA-256 of a zero byte and the data, in hex."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(data, "UTF-8")), 256)


def _level(nodes: DataFrame, base: int, proofs: bool) -> tuple[DataFrame, DataFrame]:
    """(complete aligned nodes inside blocks, a row a block or leaf) of nodes (batch, idx, node) that stand at level `base`.

    The second holds batch, block and root, and with `proofs` also idx, node and path of each leaf. Both read one written table.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        batch, block = key
        pdf = pdf.sort_values("idx")
        row = [bytes.fromhex(x) for x in pdf["node"]]
        paths: list[list[str]] = [[] for _ in row]
        where = list(range(len(row)))
        complete, n = len(row), len(row)
        rows = []
        for level in range(BLOCK_BITS + 1):
            if not proofs:
                rows += [(batch, base + level, (int(block) << (BLOCK_BITS - level)) + k, row[k].hex()) for k in range(complete)]
            if level == BLOCK_BITS:
                break
            for leaf in range(n) if proofs else ():
                at = where[leaf]
                if at ^ 1 < len(row):
                    paths[leaf].append(("L" if at & 1 else "R") + row[at ^ 1].hex())
                where[leaf] = at >> 1
            row = [_pair(row[k], row[k + 1]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
            complete >>= 1
        out = pd.DataFrame(rows, columns=["batch", "level", "pos", "hash"]).assign(path=None, idx=None, root=None)
        at = {"hash": pdf["node"].to_list(), "path": [json.dumps(p) for p in paths], "idx": pdf["idx"].to_list()} if proofs else {"hash": [None], "path": [None], "idx": [None]}
        own = pd.DataFrame({"batch": batch, "level": -1, "pos": int(block), **at, "root": row[0].hex()})
        return pd.concat([out.astype(object), own.astype(object)], ignore_index=True)

    blocks = nodes.withColumn("block", F.shiftright("idx", BLOCK_BITS)).groupBy("batch", "block")
    made = written(blocks.applyInPandas(run, "batch string, level int, pos long, hash string, path string, idx long, root string"))
    rows = made.where("level = -1").select("batch", "idx", F.col("pos").alias("block"), F.col("hash").alias("node"), F.from_json("path", "array<string>").alias("path"), "root")
    return made.where("level >= 0").select("batch", "level", "pos", "hash"), rows


def merkle_batches(leaves: DataFrame) -> DataFrame:
    """batch, idx, size, path, root for leaves (batch, idx from 0, node: hex); size: the leaves of the batch.

    path: siblings from the leaf up, each with its side. An odd last node moves up unpaired. The roots of blocks are the
    leaves of the next step, until no batch has two blocks; each step is computed once.
    """
    return merkle_proofs(leaves).drop("node")


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """merkle_batches with the node of each leaf, as verify_inclusion takes it: a proof is checked where it was made."""
    proved = _proved(leaves)
    sizes = written(proved.groupBy("batch").agg((F.max("idx") + 1).alias("size")))
    return lookup(proved, sizes, ["batch"], "inner").select("batch", "idx", "size", "node", "path", "root")


def _proved(leaves: DataFrame) -> DataFrame:
    _, paths = _level(leaves, 0, proofs=True)
    tops = paths.groupBy("batch", "block").agg(F.min("root").alias("node")).select("batch", F.col("block").alias("idx"), "node")
    if not tops.where("idx > 0").take(1):
        return paths.select("batch", "idx", "node", "path", "root")
    upper = _proved(tops).select("batch", F.col("idx").alias("block"), F.col("path").alias("more"), F.col("root").alias("top"))
    return paths.join(upper, ["batch", "block"]).select("batch", "idx", "node", F.concat("path", "more").alias("path"), F.col("top").alias("root"))


def verify_inclusion(proofs: DataFrame) -> DataFrame:
    """proofs (node, idx, size, path, root, ...) with included: the path leads from the leaf at idx of a tree of `size` leaves to the root.

    The sides come from idx and size alone: a node at an even place has its sibling on the right, one at an odd place on
    the left, and the last node of an odd level moves up by itself. An idx outside the tree, a step too few or too many, a
    sibling that isn't 32 bytes of hex, and nulls are not included. A letter before a sibling is a note for readers.
    """

    def up(acc: Column, _: Column) -> Column:
        h, idx, size, used = acc["h"], acc["idx"], acc["size"], acc["used"]
        alone = (idx == size - 1) & (size % 2 == 1)
        step = F.lower(F.get("path", used))
        sibling = F.when(step.rlike("^[lr]?[0-9a-f]{64}$"), F.right(step, F.lit(64)))
        pair = F.when(idx % 2 == 0, F.concat(F.lit("01"), h, sibling)).otherwise(F.concat(F.lit("01"), sibling, h))
        over = F.struct(
            F.when(alone, h).otherwise(F.sha2(F.unhex(pair), 256)).alias("h"),
            F.floor(idx / 2).alias("idx"),
            F.ceil(size / 2).alias("size"),
            (used + F.when(alone, 0).otherwise(1)).alias("used"),
        )
        return F.when(size > 1, over).otherwise(acc)

    inside = (F.col("idx") >= 0) & (F.col("idx") < F.col("size"))
    start = F.struct(F.lower("node").alias("h"), F.col("idx").cast("long").alias("idx"), F.col("size").cast("long").alias("size"), F.lit(0).alias("used"))
    levels = F.sequence(F.lit(1), F.length(F.bin(F.greatest(F.col("size").cast("long"), F.lit(1)))))
    good = F.aggregate(levels, start, up, lambda acc: (acc["h"] == F.lower("root")) & (acc["used"] == F.size("path")))
    return proofs.withColumn("included", F.coalesce(inside & good, F.lit(False)))


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """level, pos, hash of every complete aligned subtree over leaves (idx, node): 2**level leaves from pos * 2**level on."""
    found, rows, base = None, leaves.select(F.lit("log").alias("batch"), "idx", "node"), 0
    while True:
        nodes, blocks = _level(rows, base, proofs=False)
        if base:
            nodes = nodes.where(F.col("level") > base)  # the leaves of this step are the last nodes of the one before
        found = nodes if found is None else found.unionByName(nodes)
        if not blocks.where("block > 0").take(1):
            return found.select("level", "pos", "hash")
        base += BLOCK_BITS
        rows = nodes.where(F.col("level") == base).select("batch", F.col("pos").alias("idx"), F.col("hash").alias("node"))


def _grown(leaves: DataFrame) -> DataFrame:
    """level, pos, hash of every complete aligned subtree whose leaves are all among these (idx, node); idx starts anywhere."""

    def step(base: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            row = {int(i): bytes.fromhex(h) for i, h in zip(pdf["idx"], pdf["node"], strict=True)}
            out = [(0, i, h.hex()) for i, h in row.items()] if not base else []
            for level in range(base + 1, base + BLOCK_BITS + 1):
                row = {i >> 1: _pair(h, row[i + 1]) for i, h in row.items() if not i & 1 and i + 1 in row}
                out += [(level, i, h.hex()) for i, h in row.items()]
            return pd.DataFrame(out, columns=["level", "pos", "hash"])

        return run

    found, rows, base = None, leaves.select("idx", "node"), 0
    while True:
        nodes = written(rows.groupBy(F.shiftright("idx", BLOCK_BITS).alias("block")).applyInPandas(step(base), "level int, pos long, hash string"))
        found = nodes if found is None else found.unionByName(nodes)
        base += BLOCK_BITS
        rows = nodes.where(F.col("level") == base).select(F.col("pos").alias("idx"), F.col("hash").alias("node"))
        if len(rows.take(2)) < 2:
            return found


def peaks_of(nodes: DataFrame, size: int) -> DataFrame:
    """The nodes that the bits of size name: all that a log of that size has to keep to grow (63 rows at most)."""
    wanted = [(level, size >> (level + 1) << 1) for level in range(63) if size >> level & 1]
    return lookup(nodes, nodes.sparkSession.createDataFrame(wanted, "level int, pos long"), ["level", "pos"], "left_semi") if wanted else nodes.where("false")


def extend_log(peaks: DataFrame, size: int, leaves: DataFrame) -> tuple[DataFrame, int]:
    """(nodes, new size) of a log of `size` leaves with these peaks (level, pos, hash) after new leaves (idx from size on, node).

    nodes are the old peaks, the complete subtrees of new leaves alone, and those that join both: on the way up from the
    old end there is one a level at most, so they are folded from at most 63 rows each of old peaks and new siblings. All
    heads from `size` on, and all later ones, follow from these nodes: no old leaf is read again.
    """
    spark = leaves.sparkSession
    fresh = _grown(leaves)
    newest = leaves.agg(F.max("idx")).first()[0]
    if newest is None:
        return peaks, size
    held = {(r["level"], r["pos"]): r["hash"] for r in peaks.collect()} if size else {}
    at = [(level, ((size - 1) >> level) + 1) for level in range(63) if size and not (size - 1) >> level & 1]
    if at:
        held |= {(r["level"], r["pos"]): r["hash"] for r in lookup(fresh, spark.createDataFrame(at, "level int, pos long"), ["level", "pos"], "left_semi").collect()}
    joined, level = [], (size & -size).bit_length() - 1
    pos = (size >> level) - 1 if size else 0
    while size:
        left, right = held.get((level, pos & ~1)), held.get((level, pos | 1))
        if left is None or right is None:
            break
        level, pos = level + 1, pos >> 1
        held[level, pos] = _pair(bytes.fromhex(left), bytes.fromhex(right)).hex()
        joined.append((level, pos, held[level, pos]))
    bridges = spark.createDataFrame(joined, "level int, pos long, hash string")
    return peaks.select("level", "pos", "hash").unionByName(fresh).unionByName(bridges), newest + 1


def _folded(peaks: Column) -> Column:
    """The root of an array of (level, hash) peaks, lowest level first."""
    return F.aggregate(F.slice(peaks, 2, F.size(peaks)), F.get(peaks, F.lit(0))["hash"], lambda h, x: F.sha2(F.unhex(F.concat(F.lit("01"), x["hash"], h)), 256))


def tree_heads(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """size, root: the root over the first `size` leaves, for the tree's nodes (level, pos, hash) and sizes (size).

    A root is folded from the complete subtrees that the bits of the size name, so every head reuses the same nodes.
    """
    bits = sizes.where("size > 0").select("size", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")).where("(shiftright(size, level) & 1) = 1")
    peaks = bits.withColumn("pos", F.expr("shiftright(size, level + 1) * 2")).join(nodes, ["level", "pos"])
    packed = peaks.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("level", "hash"))).alias("p"))
    return packed.select("size", _folded(F.col("p")).alias("root"))


def consistency_proofs(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """size, next_size, old, more: what shows that the head of `size` is a prefix of the next greater one of heads (size).

    old: the subtrees (level, pos, hash) of the smaller size; more: aligned subtrees that cover the leaves added since.
    Both have at most two for each bit of the sizes.
    """
    pairs = heads.select("size", F.lead("size").over(Window.orderBy("size")).alias("next_size")).where("next_size is not null")
    level = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")
    old = pairs.select("size", "next_size", level).where("(shiftright(size, level) & 1) = 1").select("size", "next_size", F.lit(0).alias("part"), "level", F.expr("shiftright(size, level + 1) * 2").alias("pos"))
    up = "shiftright(size, level) + (CASE WHEN (size & (shiftleft(1L, level) - 1)) > 0 THEN 1 ELSE 0 END)"  # the first subtree of a level at or after the old end
    ends = pairs.select("size", "next_size", level).select("size", "next_size", "level", F.expr(up).alias("lo"), F.expr("shiftright(next_size, level)").alias("hi"))
    # of the subtrees inside the added range, those whose parent isn't inside: the first if it is a right child, the last if a left one
    inside = ends.where("lo < hi")
    more = inside.where("lo % 2 = 1").select("size", "next_size", F.lit(1).alias("part"), "level", F.col("lo").alias("pos"))
    more = more.unionByName(inside.where("hi % 2 = 1 and not (lo = hi - 1 and lo % 2 = 1)").select("size", "next_size", F.lit(1).alias("part"), "level", (F.col("hi") - 1).alias("pos")))
    found = old.unionByName(more).join(nodes, ["level", "pos"])
    packed = found.groupBy("size", "next_size").agg(F.collect_list(F.struct("part", "level", "pos", "hash")).alias("x"))
    only = lambda k: F.sort_array(F.transform(F.filter("x", lambda e: e["part"] == k), lambda e: F.struct(e["level"].alias("level"), e["pos"].alias("pos"), e["hash"].alias("hash"))))
    return packed.select("size", "next_size", only(0).alias("old"), only(1).alias("more"))


def verify_consistency(proofs: DataFrame, heads: DataFrame) -> DataFrame:
    """size, next_size, consistent: both stated roots (heads: size, root) follow from the proof alone.

    The older root is folded from `old`; `old` and `more` together, joined pairwise level by level, give the newer one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for size, after, old, more, root, newer in zip(*(b[c] for c in ("size", "next_size", "old", "more", "root", "next_root")), strict=True):
                held = {(x["level"], x["pos"]): bytes.fromhex(x["hash"]) for x in (*old, *more)}
                for level in range(63):
                    for at in sorted(p for v, p in held if v == level and not p & 1):
                        if (level, at + 1) in held:
                            held[level + 1, at >> 1] = _pair(held[level, at], held[level, at + 1])
                good.append(_root_of(held, size) == root and _root_of(held, after) == newer)
            yield pd.DataFrame({"size": b["size"], "next_size": b["next_size"], "consistent": good})

    told = proofs.join(heads.select("size", "root"), "size").join(heads.select(F.col("size").alias("next_size"), F.col("root").alias("next_root")), "next_size")
    return told.mapInPandas(run, "size long, next_size long, consistent boolean")


def _root_of(held: dict[tuple[int, int], bytes], size: int) -> str | None:
    """The root over `size` leaves from its peaks; null if one isn't there."""
    root = None
    for level in range(63):
        if size >> level & 1:
            peak = held.get((level, (size >> level) - 1))
            if peak is None:
                return None
            root = peak if root is None else _pair(peak, root)
    return root.hex() if root else None


def indexed(rows: DataFrame, batch: str, order: list[str], cell: Column) -> DataFrame:
    """rows with idx: the place in its batch, from 0. cell: a column that orders as `order` begins and cuts large batches."""
    own = rows.withColumn("_cell", cell)
    counts = own.groupBy(batch, "_cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(batch).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(batch, "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(batch, "_cell").orderBy(*order)
    return own.withColumn("_r", F.row_number().over(inside) - 1).join(bases, [batch, "_cell"]).withColumn("idx", F.col("_base") + F.col("_r")).drop("_cell", "_base", "_r")


def attest_datasets(files: DataFrame, schemas: DataFrame | None = None, lineage: DataFrame | None = None) -> DataFrame:
    """dataset_id, files, bytes, root over its file records in order of (sha256, path, size), and three hashes of its manifest.

    schemas: dataset_id, name, type: schema_hash is that of `name:type` lines in order of name. lineage: dataset_id, parent:
    lineage_hash is that of the parents in order. Either is the hash of no lines where a dataset has none. manifest_hash
    binds id, files, bytes, root and the two, so a change of any of them changes it.
    """
    cell = F.concat(F.coalesce(F.substring("sha256", 1, 4), F.lit("")))  # as many cells as four hex digits, in the order of the records
    placed = indexed(files, "dataset_id", ["sha256", "path", "size_bytes"], cell)
    text = F.concat_ws("|", "sha256", "path", F.col("size_bytes").cast("string"))
    leaves = placed.select(F.col("dataset_id").alias("batch"), "idx", leaf_hash(text).alias("node"))
    roots = merkle_batches(leaves).where("idx = 0").select(F.col("batch").alias("dataset_id"), "root")
    out = files.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")).join(roots, "dataset_id")
    for name, rows, line in (("schema_hash", schemas, "concat(name, ':', type)"), ("lineage_hash", lineage, "parent")):
        lines = F.lit("")
        if rows is not None:
            own = rows.groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_set(F.expr(line))), "\n").alias("_lines"))
            out, lines = out.join(own, "dataset_id", "left"), F.coalesce("_lines", F.lit(""))
        out = out.withColumn(name, F.sha2(lines, 256)).drop("_lines")
    return out.withColumn("manifest_hash", F.sha2(F.concat_ws("|", "dataset_id", F.col("files").cast("string"), F.col("bytes").cast("string"), "root", "schema_hash", "lineage_hash"), 256))


def workflow_edges(rows: DataFrame) -> DataFrame:
    """tenant_id, workflow_id, step, parent, present for every stated parent; only parents of the same workflow are present."""
    steps = rows.where("workflow_id is not null")
    stated = steps.where("parent_id is not null").select("tenant_id", "workflow_id", F.col("receipt_id").alias("step"), F.col("parent_id").alias("parent"))
    known = steps.select("tenant_id", "workflow_id", F.col("receipt_id").alias("parent"), F.lit(True).alias("_known"))
    return stated.join(known, ["tenant_id", "workflow_id", "parent"], "left").select("tenant_id", "workflow_id", "step", "parent", F.coalesce("_known", F.lit(False)).alias("present"))


def workflow_roots_leaves(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """tenant_id, workflow_id, step, root, leaf for steps without a present parent or without a child."""
    steps = rows.where("workflow_id is not null").select("tenant_id", "workflow_id", F.col("receipt_id").alias("step"))
    good = edges.where("present")
    up = good.select("tenant_id", "workflow_id", "step", F.lit(True).alias("_up")).distinct()
    down = good.select("tenant_id", "workflow_id", F.col("parent").alias("step"), F.lit(True).alias("_down")).distinct()
    joined = steps.join(up, ["tenant_id", "workflow_id", "step"], "left").join(down, ["tenant_id", "workflow_id", "step"], "left")
    return joined.select("tenant_id", "workflow_id", "step", F.col("_up").isNull().alias("root"), F.col("_down").isNull().alias("leaf")).where("root or leaf")


def foreign_grafts(rows: DataFrame) -> DataFrame:
    """Receipts in a workflow that another tenant owns: the owner has its first receipt, by time and id."""
    steps = rows.where("workflow_id is not null")
    owners = steps.groupBy("workflow_id").agg(F.min_by("tenant_id", F.struct("captured_at", "receipt_id")).alias("owner"))
    return steps.join(owners, "workflow_id").where("tenant_id <> owner").select("receipt_id", "tenant_id", "workflow_id", "owner")


def _inverted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """tenant_id, workflow_id of workflows with a step that doesn't stand above all its parents; all others have no cycle."""
    key = ["tenant_id", "workflow_id"]
    height = rows.where("workflow_id is not null").select(*key, F.col("receipt_id").alias("step"), F.col("chain_height").alias("_own"))
    met = edges.where("present").select(*key, "step", "parent").join(height, [*key, "step"])
    met = met.join(height.select(*key, F.col("step").alias("parent"), F.col("_own").alias("_above")), [*key, "parent"])
    return met.where("_above >= _own").select(*key).distinct()


def _depths(steps: DataFrame, links: DataFrame) -> DataFrame:
    """tenant_id, workflow_id, step, depth (parents above it on its longest way up; null on and below a cycle) of steps and links (step, parent).

    Steps with one parent at most jump: each round doubles how far up a step has looked, so a chain of a million steps takes
    twenty rounds; what hasn't reached a step without a parent after as many rounds as the count has bits is bound to a
    cycle. Where a step has several parents, rounds peel off steps whose parents all have a depth, one round a depth.
    """
    key = ["tenant_id", "workflow_id", "step"]
    links = links.select(*key, "parent").distinct()
    if not links.groupBy(*key).count().where("count > 1").take(1):
        state = written(steps.select(*key).distinct().join(links, key, "left").select(*key, F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
        for _ in range(max(1, state.count()).bit_length() + 1):
            if not state.where("up is not null").take(1):
                break
            above = state.select("tenant_id", "workflow_id", F.col("step").alias("up"), F.col("up").alias("_next"), F.col("depth").alias("_more"))
            met = state.where("up is not null").join(above, ["tenant_id", "workflow_id", "up"]).select(*key, F.col("_next").alias("up"), (F.col("depth") + F.col("_more")).alias("depth"))
            state = written(met.unionByName(state.where("up is null")))
        return state.select(*key, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    waiting = written(steps.select(*key).distinct())
    done = waiting.where("false").withColumn("depth", F.lit(0).cast("long"))
    for depth in range(waiting.count()):
        parents = waiting.select("tenant_id", "workflow_id", F.col("step").alias("parent"))
        blocked = links.join(parents, ["tenant_id", "workflow_id", "parent"], "left_semi").select(*key).distinct()
        ready = written(waiting.join(blocked, key, "left_anti"))
        if not ready.take(1):
            break
        done = done.unionByName(ready.withColumn("depth", F.lit(depth).cast("long")))
        waiting = written(waiting.join(ready, key, "left_anti"))
    return done.unionByName(waiting.withColumn("depth", F.lit(None).cast("long")))


def workflow_order(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """tenant_id, workflow_id, step, place, acyclic: parents first, ties by (height, id). Steps on or below a cycle have no place.

    Where every step stands above its parents, that order is the one of heights, counted by cells of heights, so that a
    runaway workflow isn't sorted in one task. Workflows with other steps, which a ledger that is written in order hasn't,
    are ordered by depth, then height and id; depths come from rounds of joins, places from cells again.
    """
    steps = rows.where("workflow_id is not null").select("tenant_id", "workflow_id", F.col("receipt_id").alias("step"), "chain_height")
    key = ["tenant_id", "workflow_id"]
    odd = written(_inverted(rows, edges))
    placed = indexed(steps.join(odd, key, "left_anti").withColumn("_wf", F.struct(*key)), "_wf", ["chain_height", "step"], F.floor(F.col("chain_height") / BLOCK))
    placed = placed.select(*key, "step", F.col("idx").cast("long").alias("place"), F.lit(True).alias("acyclic"))
    if not odd.take(1):
        return placed
    rest = written(steps.join(odd, key, "left_semi"))
    depths = written(_depths(rest, edges.where("present").join(odd, key, "left_semi")))
    known = rest.join(depths, [*key, "step"])
    # a cell holds the steps of one depth and block of heights; depths and heights make a number that sorts like the pair
    cell = F.struct("depth", F.floor(F.col("chain_height") / BLOCK).alias("block"))
    ordered = indexed(known.where("depth is not null").withColumn("_wf", F.struct(*key)), "_wf", ["depth", "chain_height", "step"], cell)
    cyclic = depths.where("depth is null").select(*key).distinct().withColumn("_loop", F.lit(True))
    found = ordered.select(*key, "step", F.col("idx").cast("long").alias("place")).unionByName(known.where("depth is null").select(*key, "step", F.lit(None).cast("long").alias("place")))
    return placed.unionByName(found.join(cyclic, key, "left").select(*key, "step", "place", F.col("_loop").isNull().alias("acyclic")))


def verify_workflows(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """Per tenant and workflow: steps, all receipts verified, graph complete, acyclic, no foreign graft, and all of these.

    verified: receipt_id, ok. The ledger's columns that all parts read are written once.
    """
    rows = written(rows.where("workflow_id is not null").select("tenant_id", "workflow_id", "receipt_id", "parent_id", "chain_height", "captured_at"))
    edges = written(workflow_edges(rows))
    key = ["tenant_id", "workflow_id"]
    steps = rows.select(*key, "receipt_id").join(verified.select("receipt_id", "ok"), "receipt_id", "left")
    base = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("steps"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("verified"))
    whole = edges.groupBy(*key).agg(F.bool_and("present").alias("complete"))
    odd = written(_inverted(rows, edges))
    some = rows.join(odd, key, "left_semi")
    cyclic = workflow_order(some, edges.join(odd, key, "left_semi")).where("not acyclic").select(*key, F.lit(False).alias("acyclic")).distinct()
    graft = foreign_grafts(rows).select(*key, F.lit(True).alias("grafted")).distinct()
    out = base.join(whole, key, "left").join(cyclic, key, "left").join(graft, key, "left").na.fill({"complete": True, "acyclic": True, "grafted": False})
    return out.withColumn("valid", F.col("verified") & F.col("complete") & F.col("acyclic") & ~F.col("grafted"))
