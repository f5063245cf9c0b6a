"""The pipeline, stage by stage, against plainer ways to the same rows."""

import corpus_pipeline as cp
import pytest

from crosstally.llm.common import table

from .helpers import documents
from .test_decontaminate import brute
from .test_mixing import brute_targets
from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"
IN = dict(cp.STAGES)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "near_dedup", "decontamination", "mixing"]


def test_each_stage_on_its_input(spark):
    docs = table(spark, SF, "documents")
    kept = IN["language_id"](spark, docs, SF)
    rows = docs.collect()
    assert kept.columns == docs.columns and set(ids(kept)) <= {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
    assert kept.count() > 0.97 * docs.count()

    clean = IN["toxicity"](spark, kept, SF)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = set(ids(kept)) - set(ids(clean))
    assert clean.columns == docs.columns and sum(labels.get(i, 1) == 0 for i in gone) <= 1
    assert gone  # its decisions take effect

    single = IN["near_dedup"](spark, clean, SF)
    classes = {}
    prints = [(r["doc_id"], brute_print(r["text"])) for r in clean.collect()]
    for i, c in brute_components(prints).items():
        classes.setdefault(c, []).append(i)
    assert single.columns == docs.columns and ids(single) == sorted(classes)

    pure = IN["decontamination"](spark, single, SF)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert ids(pure) == sorted(r["doc_id"] for r in single.collect() if not brute(r["text"], items)[1])

    mixed = IN["mixing"](spark, pure, SF).collect()
    sizes = {}
    for r in mixed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    assert sorted(r["doc_id"] for r in mixed) == ids(pure) and all(r["target"] == pytest.approx(want[r["source"]]) for r in mixed)


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "taken"} <= set(out.columns)
    again = cp.run(spark, SF)
    assert sorted(map(tuple, out.select("doc_id", "taken").collect())) == sorted(map(tuple, again.select("doc_id", "taken").collect()))


def test_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents(spark).columns
    left = {r["doc_id"] for r in docs.collect()}
    assert 1 in left and 2 not in left and 6 not in left and 8 not in left and 9 in left
    none = documents(spark).filter("false")
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0

