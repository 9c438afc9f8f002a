"""Loads by a ledger: only what is new is read, and a load that dies changes nothing."""

import os

import pytest

from gridwork.sources import ledger as L
from tests.test_workbooks import book


def values(cells):
    return sorted((r.file.rsplit("/", 1)[-1], r.row_idx, r.value) for r in cells.collect() if r.row_idx > 0)


def test_ledger(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    (folder / "a [1].csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_text("x,y\n3,4\n")
    (folder / "c.xlsx").write_bytes(book("<sheetData><row r='1'><c r='A1' t='inlineStr'><is><t>h</t></is></c></row><row r='2'><c r='A2'><v>9</v></c></row></sheetData>"))
    (folder / "bad.xlsx").write_bytes(b"no zip")
    ledger = L.Ledger(spark, store)
    assert ledger.load(str(folder)) == {"read": 4, "met": 0, "removed": 0}
    first = [("a [1].csv", 1, "1.0"), ("a [1].csv", 1, "2.0"), ("b.csv", 1, "3.0"), ("b.csv", 1, "4.0"), ("c.xlsx", 1, "9")]
    assert values(ledger.cells()) == first and {r.status for r in ledger.files().collect()} == {"Success", "Failed"}
    # Nothing new: nothing is read, no version is made. The same content at another time is met again, not read.
    read = []
    real = L.load
    monkeypatch.setattr(L, "load", lambda s, f: read.append(f) or real(s, f))
    assert ledger.load(str(folder)) == {"read": 0, "met": 0, "removed": 0} and not read and len(ledger.versions()) == 1
    os.utime(folder / "b.csv", (1_000_000_000, 1_000_000_000))
    assert ledger.load(str(folder)) == {"read": 0, "met": 1, "removed": 0} and values(ledger.cells()) == first
    assert not any(isinstance(f, list) for f in read)
    # Changed, new and removed files.
    (folder / "b.csv").write_text("x,y\n5,6\n7,8\n")
    (folder / "d.csv").write_text("z\n0\n")
    (folder / "c.xlsx").unlink()
    # A load that dies between its data and its commit leaves the last version; the next one does the work.
    commit = L.Ledger._commit
    monkeypatch.setattr(L.Ledger, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.load(str(folder))
    assert values(L.Ledger(spark, store).cells()) == first and len(ledger.versions()) == 2
    monkeypatch.setattr(L.Ledger, "_commit", commit)
    assert ledger.load(str(folder)) == {"read": 2, "met": 0, "removed": 1}
    now = [("a [1].csv", 1, "1.0"), ("a [1].csv", 1, "2.0"), ("b.csv", 1, "5.0"), ("b.csv", 1, "6.0"), ("b.csv", 2, "7.0"), ("b.csv", 2, "8.0"), ("d.csv", 1, "0.0")]
    assert values(L.Ledger(spark, store).cells()) == now and ledger.errors().count() == 1
    assert ledger.swept() == 1 and values(ledger.cells()) == now
    # Content that comes back is there once; of two loads of one version the second is refused.
    (folder / "d.csv").unlink()
    assert ledger.load(str(folder))["removed"] == 1
    (folder / "d.csv").write_text("z\n0\n")
    assert ledger.load(str(folder))["read"] == 1 and values(ledger.cells()) == now
    with pytest.raises(L.Conflict):
        ledger._commit(ledger.versions()[-1][0], "other")
