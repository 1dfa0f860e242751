import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as CP
from carelens.llm import near_dups, personal_data, toxicity
from carelens.llm.common import in_fold

SF = "/root/testdata/sf0.001"


def test_entry():
    keys = E.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in keys} and "pipeline" in keys
    assert [n for n, _ in CP.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]


def test_like_the_steps_by_hand(spark):
    """Stage decisions applied row by row in Python to what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = ~in_fold("doc_id", 5, 0)
    model = toxicity.learned(spark, docs.filter(known), spark.read.parquet(f"{SF}/labels.parquet").filter(known))
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(r["text"] or "") < 0.5}
    groups: dict = {}
    for i, t in rows.items():
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t), []).append(i)
    rows = {max(g): rows[max(g)] for g in groups.values()}
    from tests.llm.test_near_dups import brute
    rows = {i: rows[i] for i, _, _, kept in brute(list(rows.items())) if kept}
    left = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    finder = personal_data.learned(spark, left)
    rows = {i: personal_data.redact(t, finder.spans(t)[1]) for i, t in rows.items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows.items()}
    pieces: dict = {}
    for r in CP.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == want


def test_stages_keep_columns_and_edges(spark, frame, edge_rows, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (edge_rows, []):
        docs = frame(rows)
        for name, stage in CP.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = out
        assert CP.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= min(1, len(rows))
    clean = frame([(1, "one clean text that stays whole", "en", "s", 31), (2, "another text altogether, quite different", "en", "s", 40)])
    for _, stage in CP.STAGES[:-1]:
        assert sorted(map(tuple, stage(spark, clean, str(tmp_path)).collect())) == sorted(map(tuple, clean.collect()))


def test_null_ids_pass_near_dedup(spark, frame):
    docs = frame([(None, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1)])
    assert sorted(str(r["doc_id"]) for r in CP.near_duplicates(spark, docs, SF).collect()) == ["1", "None"]
    assert near_dups.near_duplicates(spark, docs).filter("doc_id IS NULL").first()["kept"]
