"""Round trips: each query writes a frame by a sink of the library, reads it by a source, and returns what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.operators import taxonomy as T
from stagewise.plans.model import Model
from stagewise.session import scratch
from stagewise.sources import archive as A
from stagewise.sources import files


def _archive(m: Model) -> DataFrame:
    """Targets, sequences and trials as an XML archive, read again."""
    day = F.date_format("status_date", "yyyy-MM-dd")
    trials = m.events.groupBy("target_id", "trial_id").agg(F.collect_list(F.struct(day.alias("_date"), F.col("status_raw").alias("_status"))).alias("history"))
    trials = trials.groupBy("target_id").agg(F.collect_list(F.struct(F.col("trial_id").cast("string").alias("_id"), F.lit("open").alias("status"), "history")).alias("trial"))
    seq = F.array(F.struct(F.lit("dna").alias("_type"), F.lit("ac gt").alias("_VALUE")), F.struct(F.lit("protein").alias("_type"), F.concat(F.lit("mk "), "organism").alias("_VALUE")))
    t = m.targets.join(trials, "target_id").select(F.concat("centre", F.lit("-"), "target_id").alias("_id"), F.concat(F.lit(" "), "organism", F.lit("  x")).alias("name"), F.lit("open").alias("status"), seq.alias("sequence"), "trial")
    path = scratch(m.spark, "archive")
    t.write.format("xml").option("rootTag", "archive").option("rowTag", "target").save(path)
    return A.read_targets(m.spark, path)


def xml_targets(m: Model) -> DataFrame:
    return A.targets(_archive(m))


def xml_history(m: Model) -> DataFrame:
    return A.history(_archive(m))


def xml_primary(m: Model) -> DataFrame:
    return A.sequences(_archive(m)).where("is_primary").select("target_id", "seq_idx", "sequence", "seq_md5", "seq_len")


def fasta(m: Model) -> DataFrame:
    path = scratch(m.spark, "fasta")
    A.write_fasta(m.targets.select("seq_md5", F.concat(F.lit("MK"), "seq_md5").alias("sequence")), path)
    return files.read_fasta(m.spark, path)


def tsv(m: Model) -> DataFrame:
    path = scratch(m.spark, "tsv")
    blank = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    files.write_tsv(m.table("customer").select(blank.alias("tt_id"), "c_name", "c_mktsegment"), path)
    return files.read_tsv(m.spark, path, "tt_id")


def parquet_parts(m: Model) -> DataFrame:
    path = scratch(m.spark, "labels")
    m.labels_l1.select("target_id", "gate", "label").write.partitionBy("gate").option("compression", "zstd").parquet(path)
    return m.spark.read.parquet(path).select("target_id", "gate", "label")


def serving(m: Model) -> DataFrame:
    """The columns that serving reads, materialised; nothing refers to the sources any more."""
    path = scratch(m.spark, "serving")
    m.targets.join(m.censoring.select("target_id", "max_stage", "censored"), "target_id").select("target_id", "centre", "organism", "max_stage", "censored").write.parquet(path)
    return m.spark.read.parquet(path)


def chat(m: Model) -> DataFrame:
    path = scratch(m.spark, "chat")
    c = m.table("conversations")
    files.write_chat(c.select(F.lit("s").alias("system_text"), F.coalesce("text", F.lit("")).alias("user_text"), F.coalesce("role", F.lit("")).alias("assistant_text")), path)
    r = files.read_chat(m.spark, path)
    return r.select(F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("assistant_text"))


def _tree(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, nations and customers as dump files of a taxonomy, read again: nodes, names, merged."""
    r, n, c, s = (m.table(x) for x in ("region", "nation", "customer", "supplier"))
    bar = F.lit("\t|\t")
    line = lambda *xs: F.concat(*[y for x in xs for y in (x.cast("string"), bar)][:-1], F.lit("\t|")).alias("value")
    node = lambda i, p, rank: line(i, p, F.lit(rank), F.lit(""))
    nodes = r.select(node(F.col("r_regionkey") + 10, F.lit(1), "superkingdom")).union(n.select(node(F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "phylum")))
    nodes = nodes.union(c.select(node(F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "genus"))).union(m.spark.range(1).select(node(F.lit(1), F.lit(1), "no rank")))
    sci, syn = F.lit("scientific name"), F.lit("synonym")
    names = r.select(line(F.col("r_regionkey") + 10, F.col("r_name"), F.lit(""), sci)).union(n.select(line(F.col("n_nationkey") + 100, F.col("n_name"), F.lit(""), sci)))
    names = names.union(c.select(line(F.col("c_custkey") + 1000, F.col("c_name"), F.lit(""), sci))).union(c.select(line(F.col("c_custkey") + 1000, F.concat(F.lit("cust "), "c_custkey"), F.lit(""), syn)))
    merged = s.select(line(F.col("s_suppkey") + 500_000_000, F.col("s_suppkey") + 1000))
    paths = [scratch(m.spark, x) for x in ("nodes", "names", "merged")]
    for df, path in zip((nodes, names, merged), paths, strict=True):
        df.write.text(path)
    return T.read_nodes(m.spark, paths[0]), T.read_names(m.spark, paths[1]), T.read_merged(m.spark, paths[2])


def tree_nodes(m: Model) -> DataFrame:
    nodes, names, _ = _tree(m)
    return nodes.join(T.scientific(names), "taxid", "left")


def tree_names(m: Model) -> DataFrame:
    c, n = m.table("customer"), m.table("nation")
    rows = c.select(F.concat("c_name", F.lit(" strain K 12")).alias("organism")).union(c.select(F.concat(F.lit("Cust "), "c_custkey", F.lit(" var")).alias("organism")))
    rows = rows.union(n.select(F.concat("n_name", F.lit(" sp. 4")).alias("organism"))).union(n.select(F.concat(F.lit("no "), "n_name").alias("organism")))
    return T.resolve_names(rows, "organism", T.lookup(_tree(m)[1]))


def tree_ids(m: Model) -> DataFrame:
    nodes, _, merged = _tree(m)
    return T.resolve_ids(m.table("supplier").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 500_000_000).otherwise(900_000_000)).cast("string").alias("given")), "given", nodes, merged)


def tree_lineage(m: Model) -> DataFrame:
    nodes, names, _ = _tree(m)
    return T.classify(T.lineage(nodes.join(T.scientific(names), "taxid", "left")), ("phylum", "genus"), ("ASIA", "EUROPE"))


#: query -> (what of the model, its SQL over the bridge)
CORE = {
    "s2_xml_source": (xml_targets, "SELECT concat(t.centre, '-', t.target_id) AS target_id, string_split(t.centre, '-')[1] AS centre, concat(t.organism, ' x') AS name, 'open' AS status_raw, 2 AS n_sequences, CAST(count(DISTINCT e.trial_id) AS INTEGER) AS n_trials, CAST(min(e.status_date) AS VARCHAR) AS first_seen, CAST(max(e.status_date) AS VARCHAR) AS last_seen FROM targets t JOIN events_b e ON e.target_id = t.target_id GROUP BY t.target_id, t.centre, t.organism"),
    "s3_flatten_history": (xml_history, "SELECT concat(centre, '-', target_id) AS target_id, CAST(trial_id AS BIGINT) AS trial_id, status_raw, status_date FROM events_b"),
    "s4_primary_sequence": (xml_primary, "SELECT concat(centre, '-', target_id) AS target_id, 1 AS seq_idx, concat('MK', organism) AS sequence, md5(concat('MK', organism)) AS seq_md5, CAST(length(organism) + 2 AS INTEGER) AS seq_len FROM targets"),
    "s11_tsv_source": (tsv, "SELECT CAST(c_custkey AS VARCHAR) AS tt_id, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0"),
    "s13_fasta": (fasta, "SELECT DISTINCT seq_md5 AS header, concat('MK', seq_md5) AS sequence FROM targets"),
    "s14_parquet_parts": (parquet_parts, "SELECT target_id, gate, label FROM labels_l1"),
    "s17_serving_tables": (serving, "SELECT t.target_id, t.centre, t.organism, c.max_stage, c.censored FROM targets t JOIN censoring c USING (target_id)"),
    "s18_jsonl": (chat, "SELECT coalesce(text, '') AS user_text, coalesce(role, '') AS assistant_text FROM conversations"),
    "s22_tree_dump": (tree_nodes, "SELECT CAST(r_regionkey + 10 AS BIGINT) AS taxid, CAST(1 AS BIGINT) AS parent, 'superkingdom' AS rank, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'phylum', n_name FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'genus', c_name FROM customer UNION ALL SELECT 1, 1, 'no rank', NULL"),
    "f18_name_ladder": (tree_names, "SELECT concat(c_name, ' strain K 12') AS organism, CAST(c_custkey + 1000 AS BIGINT) AS taxid FROM customer UNION ALL SELECT concat('Cust ', c_custkey, ' var'), c_custkey + 1000 FROM customer UNION ALL SELECT concat(n_name, ' sp. 4'), n_nationkey + 100 FROM nation UNION ALL SELECT concat('no ', n_name), NULL FROM nation"),
    "f19_merged_ids": (tree_ids, "SELECT CAST(s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 500000000 ELSE 900000000 END AS VARCHAR) AS given, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey + 1000 AS BIGINT) END AS taxid FROM supplier"),
    "f20_lineage": (tree_lineage, "SELECT CAST(c_custkey + 1000 AS BIGINT) AS taxid, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE '' END AS superkingdom, n_name AS tax_phylum, c_name AS tax_genus FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey + 100, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE '' END, n_name, '' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 10, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE '' END, '', '' FROM region UNION ALL SELECT 1, '', '', ''"),
}
