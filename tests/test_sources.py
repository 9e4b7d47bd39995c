import datetime as dt

from stagewise.sources import archive as A

XML = """<archive>
<target id="CTR1-7"><name> a
  name </name><status>cloned</status>
  <sequence type="dna">acgt acgt</sequence><sequence type="protein">mk l</sequence><sequence type="protein">MKV</sequence>
  <trial id="1"><status>work stopped</status><history date="2010-02-03" status="cloned"/><history date="2010" status="expressed"/></trial>
  <trial id="x"><history date="2011-13-01" status="soluble"/></trial>
</target>
<target id="CTR2-1"><sequence type="dna">acgt</sequence><sequence type="dna">AC GT</sequence></target>
<target id="CTR3-1"/>
</archive>"""


def test_archive(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    raw = A.read_targets(spark, str(tmp_path / "a.xml"))
    t = {r.target_id: r for r in A.targets(raw).collect()}
    assert set(t) == {"CTR1-7", "CTR2-1", "CTR3-1"}
    assert t["CTR1-7"].centre == "CTR1" and t["CTR1-7"].name == "a name" and t["CTR1-7"].n_trials == 2
    assert t["CTR1-7"].first_seen == "2010" and t["CTR1-7"].last_seen == "2011-13-01"
    s = A.sequences(raw).collect()
    assert {(r.target_id, r.seq_idx, r.sequence) for r in s if r.is_primary} == {("CTR1-7", 1, "MKL"), ("CTR2-1", 0, "ACGT")}
    h = {repr((r.target_id, r.trial_id, r.status_raw, r.status_date)) for r in A.history(raw).collect()}
    assert h == {repr(x) for x in (("CTR1-7", 1, "cloned", dt.date(2010, 2, 3)), ("CTR1-7", 1, "expressed", None), ("CTR1-7", None, "soluble", None))}
    A.write_fasta(A.sequences(raw), str(tmp_path / "fasta"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "fasta")).collect()]
    assert sum(x.startswith(">") for x in lines) == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    from stagewise.plans.model import Model
    from stagewise.streaming.activity import activity_stream

    m = Model(spark, sf)
    m.canon.select("target_id", "centre", "status_canon", "stage_ord", "status_date").repartition(3).write.parquet(f"{tmp_path}/events")
    schema = spark.read.parquet(f"{tmp_path}/events").schema
    stream = activity_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"), m.cfg)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity_now").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert key(spark.table("activity_now")) == key(m.activity)
