"""A query of each kind against its SQL on the smallest tables, and that all are registered."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = [
    "chunk_bounds", "interval_sample_context", "rec_running_count", "delta_cooldown", "route_stream", "content_stems", "node_merge", "spoke_attach_id", "topk_floor", "nearest_hub", "summary_grouping_sets", "merge_shards", "reference_rewrite",
    "spoke_attach_embedding", "attach_resolved", "signature", "retrieve_context", "flat_context", "expand_hits", "evicted_to_memory", "shard_split", "interval_question_counts", "annotation_errors", "stream_sessions", "stream_sliding", "scaffold_strip",
    "stream_closed_windows", "stream_settled_counts", "stream_evicted_to_memory", "media_frames", "contact_sheet_pixels", "incremental_nodes", "incremental_edges",
]


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(repr([float(x) if isinstance(x, (int, float)) else x for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert plain(got) == plain(duck.execute(entry.oracle_sql()[name]).fetchdf())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "node_id", "sim", "rank"]
