import json
import os
from datetime import date, timedelta

import pytest

from foralia.sources import daily, partitioned


def summary(day, n):
    items = [{"identificador": f"BOE-A-{day:%Y}-{day:%m%d}{k}", "titulo": f"Ley {k}/{day:%Y}, de 5 de enero, del Impuesto sobre la Renta", "url_pdf": {"texto": "u"}} for k in range(n)]
    items.append({"identificador": "BOE-A-X", "titulo": "Nombramientos en la carrera fiscal", "url_pdf": "v"})
    heading = {"nombre": "Ley", "item": items}
    return json.dumps({"data": {"sumario": {"metadatos": {"fecha_publicacion": f"{day:%Y%m%d}"}, "diario": {"seccion": {"nombre": "I", "departamento": {"nombre": "MINISTERIO DE HACIENDA", "epigrafe": heading}}}}}})


def fetchers(folder, broken=(), bodies=""):
    """Callables that leave one mark for each call, as tasks run in processes of their own."""
    os.makedirs(folder, exist_ok=True)

    def mark(name):
        with open(f"{folder}/{name}", "a") as f:
            f.write("x")

    def get_summary(day):
        mark(str(day))
        if day in broken:
            raise OSError("timeout")
        if day.weekday() == 6:
            raise LookupError(day)
        return summary(day, 2) if day.weekday() else "no summary at all"

    def get_document(ident):
        mark(ident)
        if ident.endswith("1"):
            raise OSError("gone")
        return f"<documento><texto><p>{ident}{bodies}</p></texto></documento>"

    return get_summary, get_document


FIRST = date(2024, 1, 2)  # a Tuesday


def run(spark, tmp_path, last, name="calls", dry_run=False, **how):
    paths = [str(tmp_path / p) for p in ("normas", "ledger")]
    rows = daily.ingest_days(spark, FIRST, last, *fetchers(str(tmp_path / name), **how), *paths, batch_days=3, dry_run=dry_run).collect()
    return {r["day"]: r.asDict() for r in rows}


def days(tmp_path, name="calls"):
    return {n: os.path.getsize(tmp_path / name / n) for n in os.listdir(tmp_path / name) if not n.startswith("BOE")} if (tmp_path / name).exists() else {}


def test_a_range_of_days_and_what_each_came_to(spark, tmp_path):
    monday = FIRST + timedelta(days=6)
    got = run(spark, tmp_path, monday, broken=[FIRST + timedelta(days=2)])
    assert len(got) == 7
    assert got[FIRST] | {"error": None} == {"day": FIRST, "status": "done", "error": None, "items": 3, "accepted": 2, "rejected": 1, "built": 1, "fetch_errors": 1, "added": 1, "duplicate": 0, "conflict": 0}
    assert got[FIRST + timedelta(days=2)]["status"] == "failed" and "timeout" in got[FIRST + timedelta(days=2)]["error"]
    assert got[FIRST + timedelta(days=5)]["status"] == "no_publication" and got[monday]["status"] == "unreadable"
    stored = partitioned.read_partitions(spark, str(tmp_path / "normas"), ["year"])
    assert stored.count() == 4 and {r["year"] for r in stored.collect()} == {2024}
    assert {r["day"] for r in daily.finished(spark, str(tmp_path / "ledger")).collect()} == {d for d, r in got.items() if r["status"] in ("done", "no_publication")}
    # the next run takes only what is not finished
    again = run(spark, tmp_path, monday + timedelta(days=1), "second")
    assert {d: r["status"] for d, r in again.items()} == {FIRST + timedelta(days=2): "done", monday: "unreadable", monday + timedelta(days=1): "done"}
    assert set(days(tmp_path, "second")) == {str(d) for d in again}


@pytest.mark.parametrize("dies_before_ledger", [False, True])
def test_a_killed_run_goes_on_without_repeating_a_finished_day(spark, tmp_path, monkeypatch, dies_before_ledger):
    real, calls = partitioned.append_batch, []

    def append(*args):
        calls.append(args)
        if len(calls) == 2:
            if not dies_before_ledger:
                real(*args)
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(partitioned, "append_batch", append)
    last = FIRST + timedelta(days=4)
    with pytest.raises(KeyboardInterrupt):
        run(spark, tmp_path, last)
    monkeypatch.setattr(partitioned, "append_batch", real)
    rest = run(spark, tmp_path, last, "after")
    assert set(rest) == ({FIRST + timedelta(days=3), last} if dies_before_ledger else set())
    assert all((r["added"], r["duplicate"]) == (0, 1) for r in rest.values())
    done = daily.finished(spark, str(tmp_path / "ledger"))
    assert done.count() == 5 == done.select("day").distinct().count()
    assert partitioned.read_partitions(spark, str(tmp_path / "normas"), ["year"]).count() == 5


def test_conflicts_dry_runs_and_empty_ranges(spark, tmp_path):
    dry = run(spark, tmp_path, FIRST, dry_run=True)
    assert dry[FIRST]["built"] == 1 and not (tmp_path / "normas").exists() and not (tmp_path / "ledger").exists()
    run(spark, tmp_path, FIRST)
    (tmp_path / "ledger").rename(tmp_path / "lost")
    changed = run(spark, tmp_path, FIRST, bodies=" corrected")
    assert (changed[FIRST]["added"], changed[FIRST]["conflict"]) == (0, 1)
    assert run(spark, tmp_path, FIRST - timedelta(days=1)) == {}
