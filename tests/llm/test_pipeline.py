"""The pipeline stage by stage against brute force, and its registration."""
import sys
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from precis.llm.common import written  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SMALL), f"test-{name}"))
    raw, known, single, cut, mixed, packed = kept
    assert all(k.columns == columns for k in kept[:-1])
    # language ID keeps documents with letters
    assert set(texts(known)) == {i for i, t in texts(raw).items() if any(c.isalpha() for c in t or "")}
    # one document of each component
    comp = brute.jaccard_components(list(texts(known).items()), 5, 80)
    assert set(texts(single)) == {c for _, c in comp.values()}
    # repeated strings, cut back to whole characters
    want = brute.repeated(list(texts(single).items()), 200)
    got = texts(cut)
    for i, (n, _, _, rest) in want.items():
        assert (got.get(i, "") == rest.decode("utf-8", "ignore")) or len(got[i].encode()) - len(rest) < 8
    # no document is repeated, most stay
    ids = [r["doc_id"] for r in mixed.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= set(got) and len(ids) > 0.5 * len(got)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    left = texts(mixed)
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in left.values())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.collect() == []


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op10_url_filters"])
def test_oracle(spark, name):
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from oracle_check import duck_connect, run_one
    assert run_one(spark, duck_connect(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)["status"] == "match"
