"""The pipeline against a plain version of every stage, over a whole small table."""

import hashlib

import corpus_pipeline
from pagewright.llm import byte_bpe

from tests.llm.test_documents import COMMON, plain_classes, plain_hits, plain_lines, prose


def test_pipeline(spark, tmp_path):
    import tiktoken

    base = prose(50, 150)
    item = " ".join(prose(51, 14).split())
    docs = [(k, prose(k, 60) + (f"\n{COMMON}" if k < 6 else "")) for k in range(20)]
    docs += [(20, base), (21, base), (22, base.replace(base.split()[40], "edited", 1)), (23, prose(60, 40) + " " + item + " " + prose(61, 40)), (24, item), (25, None), (26, "12 34"), (27, ""), (28, prose(62, 40))]
    rows = [(d, t, "en", f"s{d % 3}", None) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["language id"](spark, df, str(tmp_path))
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(range(29)) - {25, 26, 27}
    docs = [(d, t) for d, t in docs if d not in (25, 26, 27)]

    lined = stages["line dedup"](spark, left, str(tmp_path))
    got = {r.doc_id: r.text for r in lined.collect()}
    want = {d: h for d, _, _, h in plain_lines(docs)}
    assert lined.columns == df.columns and {d: hashlib.sha256(t.encode()).hexdigest() for d, t in got.items()} == want and COMMON in got[5] and COMMON not in got[0]

    single = stages["near dedup"](spark, lined, str(tmp_path))
    kept = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == df.columns and len(kept) == len(plain_classes(sorted(got.items()))) and 20 in kept and not {21, 22} & set(kept)

    clean = stages["decontamination"](spark, single, str(tmp_path))
    rest = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == df.columns and set(kept) - set(rest) == {24} and all(plain_hits(t, [(7, item)])[1] == 0 for t in rest.values())
    assert rest[23].split() == (prose(60, 40) + " " + prose(61, 40)).split() and all(rest[d] == kept[d] for d in rest if d != 23)

    path, pattern = byte_bpe.public_vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.Vocabulary.parse(open(path, "rb").read()).ranks, special_tokens={})
    out = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {d: theirs.encode_ordinary(t) for d, t in rest.items()}


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

