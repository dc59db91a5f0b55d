"""Scans that wait together are decided as if each slot waited by itself, with few rows of state."""

import dataclasses

import pytest
import test_live


@pytest.mark.parametrize("together", [1, 10_000])
def test_spans_of_slots_change_no_decision(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(test_live, "RULES", dataclasses.replace(test_live.RULES, together=together))
    rows = test_live.scan_rows()
    last = max(r[1] for r in rows)
    # The first batch ends within a span of both keys, so what is not due goes on waiting there.
    batches = [rows[:130], rows[130:], [(3, last + 10_000, 10_000, True, True, False, False, "a", None, 0)], [(3, last + 20_000, 10_001, True, True, False, False, "a", None, 0)]]
    got, kept = test_live.run_decisions(spark, f"file://{tmp_path}/s", batches, rows)
    assert {k: v for k, v in got.items() if k[0] != 3} == test_live.plain_decisions(rows)
    assert kept[-1] <= 3 and (max(kept) < 20) == (together > 1)
