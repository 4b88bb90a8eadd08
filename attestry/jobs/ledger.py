"""Jobs over chains, Merkle commitments and workflows, with SQL checks where SQL can express them."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from attestry.functions.canonical import ed25519_public
from attestry.functions.tables import shared_dir, written
from attestry.jobs.catalog import query
from attestry.operators import ledger as op
from attestry.sources import dims, receipts


def rows_of(spark, sf_dir):
    return receipts.receipts(spark, sf_dir)


_LINKS = """WITH links AS (SELECT receipt_id, tenant_id, CAST(chain_height AS INT) AS chain_height, CASE WHEN chain_height = 1 THEN previous_receipt_hash = repeat('0', 64)
  ELSE coalesce(previous_receipt_hash = lag(receipt_hash) OVER (PARTITION BY tenant_id ORDER BY chain_height), false) END AS link_ok FROM receipts) """


@query("verify_links", _LINKS + "SELECT * FROM links", "receipts")
def verify_links(spark, sf_dir):
    return op.verify_links(rows_of(spark, sf_dir))


def stored(spark, sf_dir):
    name = f"receipts_{uuid.uuid4().hex}"
    return op.store_receipts(rows_of(spark, sf_dir), name, shared_dir(spark, "receipts"))


@query("verify_stored_links", _LINKS + "SELECT * FROM links", "receipts")
def verify_stored_links(spark, sf_dir):
    """The same from receipts that are stored by tenant and range of heights."""
    return op.verify_stored_links(stored(spark, sf_dir))


@query("verify_chains", _LINKS + "SELECT tenant_id, count(*) AS length, min(chain_height) = 1 AS complete, min(chain_height) FILTER (NOT link_ok) AS first_broken, count(*) FILTER (NOT link_ok) AS errors, count(*) FILTER (NOT link_ok) = 0 AS valid FROM links GROUP BY 1", "receipts")
def verify_chains(spark, sf_dir):
    return op.verify_chains(op.verify_links(rows_of(spark, sf_dir)))


def damaged(spark, sf_dir):
    """The ledger with some heights dropped and some held twice."""
    rows = rows_of(spark, sf_dir).where("event_id % 997 <> 1")
    twins = rows.where("event_id % 991 = 2").withColumn("receipt_hash", F.sha2(F.concat(F.lit("twin"), "receipt_hash"), 256))
    return rows.unionByName(twins)


_DAMAGED = """WITH damaged AS (SELECT tenant_id, chain_height, receipt_hash FROM receipts WHERE event_id % 997 <> 1 UNION ALL SELECT tenant_id, chain_height, sha256('twin' || receipt_hash) FROM receipts WHERE event_id % 997 <> 1 AND event_id % 991 = 2) """


@query("chain_gaps_forks", _DAMAGED + """, h AS (SELECT tenant_id, chain_height, count(*) AS n, lead(chain_height) OVER (PARTITION BY tenant_id ORDER BY chain_height) AS nxt FROM damaged GROUP BY 1, 2)
SELECT tenant_id, 'fork' AS kind, CAST(chain_height AS INT) AS from_height, CAST(chain_height AS INT) AS to_height FROM h WHERE n > 1 UNION ALL SELECT tenant_id, 'gap', CAST(chain_height + 1 AS INT), CAST(nxt - 1 AS INT) FROM h WHERE nxt > chain_height + 1""", "receipts")
def chain_gaps_forks(spark, sf_dir):
    return op.chain_gaps_forks(damaged(spark, sf_dir))


@query("authoritative_receipts", _DAMAGED + "SELECT tenant_id, CAST(chain_height AS INT) AS chain_height, min(receipt_hash) AS receipt_hash FROM damaged GROUP BY 1, 2", "receipts")
def authoritative_receipts(spark, sf_dir):
    return op.authoritative(damaged(spark, sf_dir))


@query("chain_heads", "SELECT tenant_id, CAST(max(chain_height) AS INT) AS chain_height, arg_max(receipt_hash, chain_height) AS receipt_hash, arg_max(receipt_id, chain_height) AS receipt_id FROM receipts GROUP BY 1", "receipts")
def chain_heads(spark, sf_dir):
    return op.chain_heads(rows_of(spark, sf_dir))


@query("pack_manifest", """WITH p AS (SELECT tenant_id, captured_at[1:7] AS period, string_agg(DISTINCT p, ',' ORDER BY p) AS policies FROM (SELECT tenant_id, captured_at, unnest(applied_policies) AS p FROM receipts) GROUP BY 1, 2)
SELECT r.tenant_id, captured_at[1:7] AS period, count(*) AS receipts, CAST(min(chain_height) AS INT) AS first_height, CAST(max(chain_height) AS INT) AS last_height, arg_max(receipt_hash, chain_height) AS head_hash, coalesce(any_value(policies), '') AS policies
FROM receipts r LEFT JOIN p ON p.tenant_id = r.tenant_id AND p.period = captured_at[1:7] GROUP BY 1, 2""", "receipts")
def pack_manifest(spark, sf_dir):
    return op.pack_manifest(rows_of(spark, sf_dir))


@query("registry_history", """WITH e AS (SELECT use_case_id || '-' || user_name AS id, chain_height AS version, receipt_hash AS entry_hash, CASE WHEN event_id % 50 = 7 THEN 'x' ELSE lag(receipt_hash) OVER (PARTITION BY use_case_id, user_name ORDER BY chain_height) END AS previous_version_hash FROM receipts),
l AS (SELECT *, lag(entry_hash) OVER w AS last, lead(version) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY id ORDER BY version))
SELECT id, CAST(version AS INT) AS version, nxt IS NULL AS current, CASE WHEN last IS NULL THEN previous_version_hash IS NULL ELSE coalesce(previous_version_hash = last, false) END AS link_ok FROM l""", "receipts")
def registry_history(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    from pyspark.sql import Window

    last = F.lag("receipt_hash").over(Window.partitionBy("use_case_id", "user_name").orderBy("chain_height"))
    entries = rows.select(F.concat_ws("-", "use_case_id", "user_name").alias("id"), F.col("chain_height").alias("version"), F.col("receipt_hash").alias("entry_hash"), F.when(F.col("event_id") % 50 == 7, "x").otherwise(last).alias("previous_version_hash"))
    return op.registry_history(entries)


def bodies(spark, sf_dir):
    """Receipt bodies as JSON text."""
    rows = rows_of(spark, sf_dir)
    return rows.withColumn("body", F.to_json(F.struct("tenant_id", "receipt_id", "vendor", "model", "input_tokens", "kind", "captured_at")))


def test_seeds():
    """A fixed test seed for each kid of the derived receipts."""
    return {kid: hashlib.sha256(f"attestry test key {kid}".encode()).hexdigest() for kid, *_ in dims.KEYS}


def public_keys():
    return {kid: ed25519_public(bytes.fromhex(seed)).hex() for kid, seed in test_seeds().items()}


def signed_bodies(spark, sf_dir):
    """The ledger with body texts, their hashes and signatures of the test keys.

    Planted: every 499th body is changed after hashing; every 101st signature is of another text, every 103rd kid is unknown.
    """
    rows = bodies(spark, sf_dir)
    sorted_text = F.to_json(F.struct("captured_at", "input_tokens", "kind", "model", "receipt_id", "tenant_id", "vendor"))
    changed = F.when(F.col("event_id") % 499 == 0, F.regexp_replace("body", "tenant", "tenanT")).otherwise(F.col("body"))
    # heights are made by tenant; from here on a tenant's receipts are dealt over all tasks
    hashed = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "receipt_id").select("receipt_id", "tenant_id", "chain_height", "event_id", changed.alias("raw"), F.sha2(sorted_text, 256).alias("_hash"), "kid")
    told = hashed.withColumn("receipt_hash", F.when(F.col("event_id") % 101 == 0, F.sha2("_hash", 256)).otherwise(F.col("_hash")))
    signed = op.sign_receipts(told, test_seeds()).withColumn("receipt_hash", F.col("_hash")).drop("_hash")
    return signed.withColumn("kid", F.when(F.col("event_id") % 103 == 0, "kid-stranger").otherwise(F.col("kid")))


@query("verify_receipts", "SELECT receipt_id, event_id % 499 <> 0 AS hash_ok, event_id % 101 <> 0 AND event_id % 103 <> 0 AS signature_ok FROM receipts", "receipts")
def verify_receipts(spark, sf_dir):
    """Hashes recomputed from canonical text, signatures checked under the public keys."""
    return op.verify_receipts(signed_bodies(spark, sf_dir), public_keys())


def envelopes(spark, sf_dir):
    """Whole envelopes. Planted: every 107th has no signature, every 109th a previous hash that isn't its place's, every 113th a foreign time stamp, every 127th a first signature of another kind."""
    rows = signed_bodies(spark, sf_dir)
    first, k = F.col("chain_height") == 1, F.col("event_id")
    zeros, other = F.lit(op.ZERO), F.sha2(F.col("receipt_id"), 256)
    previous = F.when(first != (k % 109 == 0), zeros).otherwise(other)
    own = F.struct("kid", F.lit("EdDSA").alias("alg"), F.col("signature").alias("sig"))
    odd = F.struct("kid", F.lit("ES256").alias("alg"), F.col("signature").alias("sig"))
    kinds = F.when(k % 107 == 0, F.slice(F.array(own), 1, 0)).when(k % 127 == 0, F.array(odd, own)).otherwise(F.array(own))
    imprint = F.when(k % 113 == 0, other).otherwise(F.col("receipt_hash"))
    return rows.select("receipt_id", "tenant_id", "chain_height", "receipt_hash", "raw", previous.alias("previous_receipt_hash"), kinds.alias("signatures"), F.array(F.struct(imprint.alias("imprint"))).alias("timestamps"))


_CHECKED = """WITH c AS (SELECT receipt_id, tenant_id, event_id, chain_height, event_id % 107 <> 0 AS envelope_ok, event_id % 499 <> 0 AS hash_ok, event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 107 <> 0 AS signature_ok, event_id % 109 <> 0 AS genesis_ok, event_id % 113 <> 0 AS imprint_ok FROM receipts),
checked AS (SELECT *, concat_ws(',', CASE WHEN NOT envelope_ok THEN 'envelope' END, CASE WHEN NOT hash_ok THEN 'hash' END, CASE WHEN NOT signature_ok THEN 'signature' END, CASE WHEN NOT genesis_ok THEN 'genesis' END, CASE WHEN NOT imprint_ok THEN 'imprint' END) AS errors FROM c) """


@query("verify_envelopes", _CHECKED + "SELECT receipt_id, envelope_ok, hash_ok, signature_ok, genesis_ok, imprint_ok, errors, errors = '' AS valid FROM checked", "receipts")
def verify_envelopes(spark, sf_dir):
    return op.verify_envelopes(envelopes(spark, sf_dir), public_keys())


@query("seal_chain")
def seal_chain(spark, sf_dir):
    """The events after 2024-01-15 sealed on top of the chains that those before make."""
    rows = bodies(spark, sf_dir)
    cut = F.lit("2024-01-15T00:00:00Z")
    before = op.seal_chain(rows.where(F.col("captured_at") < cut))
    heads = before.groupBy("tenant_id").agg(F.max("chain_height").alias("chain_height"), F.max_by("receipt_hash", "chain_height").alias("receipt_hash"))
    return before.unionByName(op.seal_chain(rows.where(F.col("captured_at") >= cut), heads))


def leaves(spark, sf_dir):
    """One leaf a receipt in batches by tenant, in chain order."""
    return rows_of(spark, sf_dir).select(F.col("tenant_id").alias("batch"), (F.col("chain_height") - 1).cast("long").alias("idx"), op.leaf_hash(F.col("receipt_hash")).alias("node"))


@query("merkle_batches")
def merkle_batches(spark, sf_dir):
    rows = leaves(spark, sf_dir)
    found = op.merkle_batches(rows)
    return found.select("batch", "idx", F.size("path").alias("steps"), F.sha2(F.concat_ws(",", "path"), 256).alias("path_sha256"), "root")


@query("verify_inclusion", "SELECT tenant_id AS batch, count(*) AS leaves, count(*) FILTER (event_id % 499 <> 0) AS included FROM receipts GROUP BY 1", "receipts")
def verify_inclusion(spark, sf_dir):
    """Every leaf proved; the leaves of every 499th event are changed first and must fail."""
    rows = leaves(spark, sf_dir)
    changed = rows_of(spark, sf_dir).where("event_id % 499 = 0").select(F.col("tenant_id").alias("batch"), (F.col("chain_height") - 1).cast("long").alias("idx"), F.lit(True).alias("changed"))
    proofs = op.merkle_proofs(rows).join(changed, ["batch", "idx"], "left")
    checked = op.verify_inclusion(proofs.withColumn("node", F.when(F.col("changed"), F.sha2("node", 256)).otherwise(F.col("node"))))
    return checked.groupBy("batch").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("included").alias("included"))


@query("verify_inclusion_planted", """SELECT tenant_id AS batch, CAST(event_id % 11 AS INT) AS kind, count(*) AS leaves, count(*) FILTER (event_id % 11 NOT BETWEEN 1 AND 6) AS included FROM receipts GROUP BY ALL""", "receipts")
def verify_inclusion_planted(spark, sf_dir):
    """Proofs with an index that is a tree's size too large, another leaf's index, a spare node, a missing one, a tree that is twice as large, and a negative index."""
    rows = leaves(spark, sf_dir)
    kind = rows_of(spark, sf_dir).select(F.col("tenant_id").alias("batch"), (F.col("chain_height") - 1).cast("long").alias("idx"), (F.col("event_id") % 11).cast("int").alias("kind"))
    proofs = op.merkle_proofs(rows).join(kind, ["batch", "idx"])
    k = F.col("kind")
    path = F.when(k == 3, F.concat("path", F.array("node"))).when(k == 4, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path"))
    idx = F.when(k == 1, F.col("idx") + F.col("size")).when(k == 2, F.col("idx").bitwiseXOR(F.lit(1))).when(k == 6, -F.col("idx") - 1).otherwise(F.col("idx"))
    checked = op.verify_inclusion(proofs.withColumn("path", path).withColumn("idx", idx).withColumn("size", F.when(k == 5, 2 * F.col("size")).otherwise(F.col("size"))))
    return checked.groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("included").alias("included"))


_BAD = "event_id % 499 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0 OR event_id % 113 = 0"


_LOST = "tenant_id = 'tenant-8' AND (chain_height - 1) % 211 = 5"


@query("verify_pack", f"""WITH c AS (SELECT keys, tenant_id, count(*) AS receipts, count(*) FILTER (keys = 'none' OR {_BAD} OR {_LOST}) AS failed, keys <> 'none' AND tenant_id <> 'tenant-7' AND count(*) FILTER ({_LOST}) = 0 AS pack_hash_matches,
  keys <> 'none' AND count(*) FILTER ({_LOST}) = 0 AS all_receipts_included, keys <> 'none' AND count(*) FILTER ({_BAD}) = 0 AS all_signatures_valid FROM receipts, (VALUES ('external'), ('none')) AS k(keys) GROUP BY 1, 2)
SELECT keys, tenant_id, receipts, failed, pack_hash_matches AND all_receipts_included AND all_signatures_valid AS valid, pack_hash_matches, all_receipts_included, all_signatures_valid FROM c""", "receipts")
def verify_pack(spark, sf_dir):
    """Pack hash, and envelope, body hash, signature and inclusion of every receipt of a tenant's pack, under the external keys and, to the same packs, with none.

    Planted after the packs were made: tenant-7's states another hash, tenant-8's has lost every 211th proof.
    """
    held, proofs, manifests = packs(spark, sf_dir)
    proofs = proofs.where("not (tenant_id = 'tenant-8' and idx % 211 = 5)")
    manifests = manifests.withColumn("pack_hash", F.when(F.col("tenant_id") == "tenant-7", F.sha2("pack_hash", 256)).otherwise(F.col("pack_hash")))
    sets = spark.createDataFrame([(name, bool(keys)) for name, keys in key_sets().items()], "keys string, keyed boolean")
    hashes = op.pack_hash_checks(held, proofs, manifests).crossJoin(F.broadcast(sets))
    return op.verify_pack(pack_checks(held, proofs, manifests), ("keys", "tenant_id"), hashes)


_SIGNED = "event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 107 <> 0"


@query("pack_failures", f"""SELECT keys, tenant_id, receipt_id, concat_ws(',', CASE WHEN event_id % 499 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0 OR event_id % 113 = 0 THEN 'body' END, CASE WHEN keys = 'none' OR NOT ({_SIGNED}) THEN 'signature' END) AS failed
  FROM receipts, (VALUES ('external'), ('none')) AS k(keys) WHERE keys = 'none' OR {_BAD}""", "receipts")
def pack_failures(spark, sf_dir):
    """What each receipt of the packs fails."""
    return op.pack_failures(pack_checks(*packs(spark, sf_dir)), by=("keys", "tenant_id"))


def packs(spark, sf_dir):
    """The pack of each tenant, in chain order."""
    return op.build_packs(envelopes(spark, sf_dir).withColumn("idx", (F.col("chain_height") - 1).cast("long")))


def key_sets():
    return {"external": public_keys(), "none": None}


def pack_checks(held, proofs, manifests):
    """keys, tenant_id, receipt_id, hash_ok (with the envelope's other checks), signature_ok and included of each receipt of the packs, under each set of keys."""
    checks = op.envelope_checks(held.withColumn("leaf", op.leaf_hash(F.col("receipt_hash"))), key_sets(), ("tenant_id", "idx", "leaf"))
    body = F.col("hash_ok") & F.col("envelope_ok") & F.col("genesis_ok") & F.col("imprint_ok")
    return op.with_inclusion(checks.withColumn("hash_ok", body), proofs, manifests)


def logged(spark, sf_dir):
    """The transparency log: idx, node and day of each receipt, by time. Cells of ten minutes, so no day is sorted in one task."""
    rows = rows_of(spark, sf_dir)
    placed = op.indexed(rows.withColumn("log", F.lit("log")), "log", ["ts", "event_id"], F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600))
    return placed.select("idx", F.sha2(F.concat_ws(":", "tenant_id", "receipt_hash"), 256).alias("node"), "captured_day", "ts")


@query("tree_heads")
def tree_heads(spark, sf_dir):
    """The log's root at the end of each day."""
    rows = logged(spark, sf_dir)
    return op.tree_heads(op.tree_nodes(rows), rows.groupBy("captured_day").agg((F.max("idx") + 1).alias("size")))


@query("log_heads", """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n FROM receipts GROUP BY 1)
SELECT strftime(start, '%Y-%m-%dT%H:%M:%S') AS window_start, CAST(sum(n) OVER (ORDER BY start) AS BIGINT) AS size, true AS as_rebuilt FROM w""", "receipts")
def log_heads(spark, sf_dir):
    """A head every five minutes in four runs; a run has the peaks that the one before left and reads new leaves only. Each is held against the head of a rebuilt tree."""
    rows = written(logged(spark, sf_dir))
    start = F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"]
    sizes = written(rows.groupBy(start.alias("start")).agg((F.max("idx") + 1).alias("size")))
    peaks, size, heads = spark.createDataFrame([], "level int, pos long, hash string"), 0, None
    for until in ("2024-01-08", "2024-01-16", "2024-01-24", "9999-01-01"):
        nodes, grown = op.extend_log(peaks, size, rows.where((F.col("idx") >= size) & (F.col("ts") < F.lit(until).cast("timestamp_ntz"))).select("idx", "node"))
        nodes = written(nodes)
        new = op.tree_heads(nodes, sizes.where((F.col("size") > size) & (F.col("size") <= grown)))
        heads = new if heads is None else heads.unionByName(new)
        peaks, size = written(op.peaks_of(nodes, grown)), grown
    rebuilt = op.tree_heads(op.tree_nodes(rows), sizes).withColumnRenamed("root", "_root")
    found = sizes.join(heads, "size").join(rebuilt, "size")
    return found.select(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "size", (F.col("root") == F.col("_root")).alias("as_rebuilt"))


@query("tree_consistency", """WITH s AS (SELECT captured_day, CAST(sum(n) OVER (ORDER BY captured_day) AS BIGINT) AS size FROM (SELECT captured_day, count(*) AS n FROM receipts GROUP BY 1)),
h AS (SELECT size, lead(size) OVER (ORDER BY size) AS next_size FROM s) SELECT size, next_size, size % 3 <> 0 AND next_size % 3 <> 0 AS consistent FROM h WHERE next_size IS NOT NULL""", "receipts")
def tree_consistency(spark, sf_dir):
    """Each day's head against the next one's by a proof; heads of a size that 3 divides are stated with another root."""
    rows = logged(spark, sf_dir)
    nodes = op.tree_nodes(rows)
    heads = op.tree_heads(nodes, rows.groupBy("captured_day").agg((F.max("idx") + 1).alias("size")))
    stated = heads.withColumn("root", F.when(F.col("size") % 3 == 0, F.sha2("root", 256)).otherwise(F.col("root")))
    return op.verify_consistency(op.consistency_proofs(nodes, heads), stated)


@query("attest_datasets")
def attest_datasets(spark, sf_dir):
    files = receipts.table(spark, sf_dir, "dataset_files")
    fields = [(n, t) for n, t in spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes]
    names = files.select("dataset_id").distinct()
    schemas = names.withColumn("f", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in fields]))).select("dataset_id", "f.*")
    lineage = names.select("dataset_id", F.explode(F.array(F.lit("crawl"), F.concat(F.lit("raw/"), "dataset_id"))).alias("parent"))
    return op.attest_datasets(files, schemas, lineage)


@query("attest_dataset_totals", """SELECT dataset_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, sha256('doc_id:bigint' || chr(10) || 'lang:string' || chr(10) || 'n_chars:bigint' || chr(10) || 'source:string' || chr(10) || 'text:string') AS schema_hash,
  sha256('crawl' || chr(10) || 'raw/' || dataset_id) AS lineage_hash FROM dataset_files GROUP BY 1""", "dataset_files")
def attest_dataset_totals(spark, sf_dir):
    return attest_datasets(spark, sf_dir).drop("root", "manifest_hash")


_EDGES = """WITH edges AS (SELECT r.tenant_id, r.workflow_id, r.receipt_id AS step, r.parent_id AS parent, p.receipt_id IS NOT NULL AS present FROM receipts r LEFT JOIN receipts p ON p.tenant_id = r.tenant_id AND p.workflow_id = r.workflow_id AND p.receipt_id = r.parent_id WHERE r.parent_id IS NOT NULL),
grafts AS (SELECT receipt_id, tenant_id, workflow_id, owner FROM receipts JOIN (SELECT workflow_id, arg_min(tenant_id, captured_at || receipt_id) AS owner FROM receipts GROUP BY 1) USING (workflow_id) WHERE tenant_id <> owner) """


@query("workflow_edges", _EDGES + "SELECT * FROM edges", "receipts")
def workflow_edges(spark, sf_dir):
    return op.workflow_edges(rows_of(spark, sf_dir))


@query("workflow_roots_leaves", _EDGES + """, s AS (SELECT tenant_id, workflow_id, receipt_id AS step, receipt_id NOT IN (SELECT step FROM edges WHERE present) AS root, receipt_id NOT IN (SELECT parent FROM edges WHERE present) AS leaf FROM receipts) SELECT * FROM s WHERE root OR leaf""", "receipts")
def workflow_roots_leaves(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return op.workflow_roots_leaves(rows, op.workflow_edges(rows))


@query("foreign_grafts", _EDGES + "SELECT * FROM grafts", "receipts")
def foreign_grafts(spark, sf_dir):
    return op.foreign_grafts(rows_of(spark, sf_dir))


@query("workflow_order", _EDGES + "SELECT tenant_id, workflow_id, receipt_id AS step, CAST(row_number() OVER (PARTITION BY tenant_id, workflow_id ORDER BY chain_height, receipt_id) - 1 AS BIGINT) AS place, true AS acyclic FROM receipts", "receipts")
def workflow_order(spark, sf_dir):
    """Parents stand at lower heights in this ledger, so the order is that of heights; cycles are tested apart."""
    rows = rows_of(spark, sf_dir)
    return op.workflow_order(rows, op.workflow_edges(rows))


@query("verify_workflows", _CHECKED + _LINKS.strip().replace("WITH ", ", ", 1) + _EDGES.strip().replace("WITH ", ", ", 1) + """, b AS (SELECT r.tenant_id, workflow_id, count(*) AS steps, bool_and(link_ok AND hash_ok AND signature_ok) AS verified FROM receipts r JOIN links USING (receipt_id) JOIN checked USING (receipt_id) GROUP BY ALL),
g AS (SELECT tenant_id, workflow_id, bool_and(present) AS complete FROM edges GROUP BY ALL)
SELECT b.*, coalesce(complete, true) AS complete, true AS acyclic, (b.tenant_id, b.workflow_id) IN (SELECT (tenant_id, workflow_id) FROM grafts) AS grafted, verified AND coalesce(complete, true) AND NOT ((b.tenant_id, b.workflow_id) IN (SELECT (tenant_id, workflow_id) FROM grafts)) AS valid
FROM b LEFT JOIN g USING (tenant_id, workflow_id)""", "receipts")
def verify_workflows(spark, sf_dir):
    """A receipt is verified by its link, its hash and its signature (which verify_workflows of unsigned envelopes lack too)."""
    rows = rows_of(spark, sf_dir)
    links = op.verify_links(rows).select("receipt_id", "link_ok")
    checks = op.verify_envelopes(envelopes(spark, sf_dir), public_keys()).select("receipt_id", "hash_ok", "signature_ok")
    return op.verify_workflows(rows, links.join(checks, "receipt_id").select("receipt_id", (F.col("link_ok") & F.col("hash_ok") & F.col("signature_ok")).alias("ok")))
