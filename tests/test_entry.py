import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "customer", "documents", "embeddings", "pages")


def test_entry(spark):
    assert e.entry(spark).count() > 0


def _flat(rows):
    return sorted(tuple("" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["timeline_first_page", "near_duplicates", "fold_actions", "capture_dates", "diff_listing", "remote_pull", "export_plan", "destinations", "unique_names", "move_plan", "flatten_plan", "date_rank", "content_hashes", "reconcile_hashed", "reconcile_mixed", "relinked", "decisions_applied", "live_pairs_by_identifier", "account_states_read_back", "source_states_read_back", "streamed_daily_counts", "streamed_pull", "streamed_decisions", "streamed_near_duplicates", "streamed_listing", "streamed_snapshots", "streamed_run_report", "listed_tree", "hashed_tree", "account_documents", "timeline_last_page", "timeline_around", "date_rank_stored", "near_duplicates_crowded", "remote_lookalikes", "redundant_copies_by_window", "moves_applied", "flattened_catalog", "landed_clips", "disconnect_report", "phash_of_vectors", "run_report_observed"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({e.oracle_sql()[name]})").fetchall()
    assert _flat(df.select(*cols).collect()) == _flat(got)
