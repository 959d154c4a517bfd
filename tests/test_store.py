"""Storage: compaction changes nothing but the files, and erased data leaves them."""

import glob

import pyarrow.parquet as pq
from test_state import frames, history, simulate

from consentry.operators import state
from consentry.sources import store
from consentry.spec import KEY, PII


def stored_values(root):
    seen = set()
    for f in glob.glob(f"{root}/**/*.parquet", recursive=True):
        table = pq.ParquetFile(f).read()
        for c in PII:
            seen |= set(table.column(c).to_pylist())
    return seen


def unplaced(registry):
    """Records by key, with the number of the write alone as their order."""
    return {r[KEY]: r.asDict() | {"row_order": r.row_order.seq} for r in registry.collect()}


def test_compaction_between_batches_changes_no_result(spark, folder):
    log = history(11, n=600)
    whole, _, _ = simulate(log, True)
    for b in range(3):
        ingest, change = frames(spark, log[b * 200:(b + 1) * 200], 2)
        store.append_writes(state.union_writes(ingest, change), folder, b)
        # A batch delivered twice replaces itself.
        store.append_writes(state.union_writes(ingest, change), folder, b)
        if b < 2:
            store.compact(spark, folder)
    assert unplaced(store.current(spark, folder)) == whole
    store.compact(spark, folder)
    assert unplaced(store.snapshot(spark, folder)) == whole and len(store.versions(spark, folder)) == 1


def test_erased_personal_data_is_in_no_file_after_compaction(spark, folder):
    log = history(12, n=600)
    registry, _, _ = simulate(log, True)
    ingest, change = frames(spark, log, 2)
    erased = {k for k, r in registry.items() if r["status"] == "Anonymized"}
    private = {r[c] for _, op, r in log if op == "ingest" and r[KEY] in erased for c in PII}
    store.append_writes(state.union_writes(ingest, change), folder, 0)
    assert private & stored_values(folder)
    store.compact(spark, folder)
    assert erased and not private & stored_values(folder)
