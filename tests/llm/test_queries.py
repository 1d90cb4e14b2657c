"""The queries whose rows SQL can express against DuckDB, and the columns of the contracts."""

import duckdb
import pytest

from voxmill.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_rabitq": ["vec_id", "n_links", "component_id", "kept"],
}


def test_names():
    found = set(queries())
    assert {n.split("_")[0] for n in found} == {*(f"op{i}" for i in range(1, 11)), "pipeline"} and set(COLUMNS) <= found


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    got = queries()[name](spark, DIR)
    assert got.columns == COLUMNS[name]
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("pages", "conversations", "embeddings"):
            con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        rel = con.execute(oracle_sql()[name])
        names = [c[0] for c in rel.description]
        want = sorted(([r[names.index(c)] for c in got.columns] for r in rel.fetchall()), key=str)
        assert sorted(map(list, got.collect()), key=str) == want


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES:
        out = stage(spark, docs, DIR)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and now
        ids, docs = now, out
    assert {r.doc_id for r in p.run(spark, DIR).select("doc_id").collect()} == ids


def test_chat_keeps_tied_turns(spark, tmp_path):
    """Rows of a conversation with the same turn, the same text or no turn all count, as in the SQL."""
    import hashlib

    from voxmill.llm.queries import op6_chat

    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, None, "user", "e"), (1, None, "user", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (got,) = op6_chat(spark, str(tmp_path)).filter("conv_id = 1").collect()
    told = "".join(f"{r}\n{t}\n" for r, t in (("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c"), ("user", "d"), ("user", "e")))
    assert got.n_turns == 6 and got.loss_chars == 2 and got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
