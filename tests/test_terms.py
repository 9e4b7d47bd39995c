"""Edges of rules whose SQL both engines share, against values worked out by hand."""

import pytest

from stagewise.plans import portable, terms


def test_reliability_bins(spark):
    p = [0.0, 0.05, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
    labels = spark.createDataFrame([(i, 0, "cleared", True) for i in range(len(p))], "target_id long, gate int, label string, in_loss boolean")
    context = spark.createDataFrame([(i, 0, x) for i, x in enumerate(p)], "target_id long, gate int, cluster_base_rate double")
    got = {r.bin: r.n for r in spark.sql(portable.SHARED["m13_reliability"], labels_l1=labels, context=context).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2}


@pytest.mark.parametrize("text, kind", [("4XB7", "pdb"), ("4XB7_A", "pdb"), ("4XB7:ABCD", "pdb"), ("4XB7_ABCDEFG", None), ("0XB7", None), ("P0A6Y8", "uniprot"), ("P0A6Y8-2", "uniprot"), ("A0A023GPI8", "uniprot"), ("P0A6Y", None), (">x", "fasta")])
def test_sniff(spark, text, kind):
    typed = spark.createDataFrame([(text,)], "t string")
    assert spark.sql(f"SELECT {terms.sniff('spark', 't')} AS kind FROM {{typed}}", typed=typed).first().kind == kind
