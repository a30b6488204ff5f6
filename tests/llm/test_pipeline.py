
import zstandard

from tallyglass.llm import quality
from tests.llm.test_packing import check
from tests.llm.test_similar import jaccard
from tests.llm.test_suffixes import covered_by_brute

DATA = "/root/testdata/sf0.001"


def one_of_each_group(texts):
    """The smallest id of each group that links of similarity 0.8 or more join."""
    least = {i: i for i in texts}
    ids = sorted(texts)
    links = [(i, j) for i in ids for j in ids if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    for _ in ids:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    return set(least.values())


def test_stages_against_brute_force(spark):
    """Each stage on its own input, then the whole run."""
    import corpus_pipeline as pipeline
    from tallyglass.llm.common import Scratch

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    scratch = Scratch(spark, "t")
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, DATA))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality rules":
            assert after == {i: t for i, t in before.items() if quality.judge(t.encode(), packer).kept}
        elif name == "language ID":
            assert set(after) <= set(before) and len(after) > 0.95 * len(before)
        elif name == "SimHash near-dedup":
            assert set(after) == one_of_each_group(before)
        else:
            assert not covered_by_brute(after)
            untouched = set(before) - set(covered_by_brute(before))
            assert all(after[i] == before[i] for i in untouched)
    from tokenizers import Tokenizer

    from tallyglass.llm import packing

    t = Tokenizer.from_file(packing.default_path())
    rows = pipeline.run(spark, DATA).collect()
    check(rows, lambda text: t.encode(text, add_special_tokens=False).ids, after)
    assert {r.doc_id for r in rows} == set(after)
