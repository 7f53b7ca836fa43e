"""The persisted index: incremental refresh, touch-only changes, two writers, old versions."""

import pytest

from quillgraph.operators import facts
from quillgraph.plans.index import VaultIndex
from quillgraph.plans.store import StaleIndex, VaultStore

SCHEMA = "path string, text string, mtime double"


def note(i, extra=""):
    return f"---\ntags: [t{i}]\n---\n# Head {i}\n\n- [ ] do {i} #x{i}\nsee [[n{i + 1}]]{extra}\n"


def test_refresh(spark, tmp_path):
    rows = {f"a/n{i}.md": (note(i), float(i)) for i in range(30)}
    frame = lambda r: spark.createDataFrame([(p, *x) for p, x in r.items()], SCHEMA)
    store = VaultStore(spark, f"file://{tmp_path}/s", buckets=8)
    assert store.meta() is None and store.notes() is None
    first = store.refresh(frame(rows))
    assert (first["version"], first["file_count"], first["changed_count"]) == (1, 30, 30)
    later = dict(rows)
    del later["a/n3.md"]
    later["a/n5.md"] = (note(5, " and [[other]]"), 50.0)
    later["a/n6.md"] = (later["a/n6.md"][0], 60.0)  # touched
    later["b/new.md"] = (note(99), 1.0)
    meta = store.refresh(frame(later))
    assert [meta[x] for x in ("version", "previous", "file_count", "changed_count", "deleted_count", "unchanged_count")] == [2, 1, 30, 3, 1, 27]
    assert any(x.startswith("data/v1/") for x in meta["folders"].values())  # buckets without a change are taken over
    fresh = facts.parse(frame(later))
    for rows_of in (facts.headings, facts.tasks, facts.wikilinks, facts.tags, facts.frontmatter):
        assert sorted(map(tuple, rows_of(store.notes()).collect())) == sorted(map(tuple, rows_of(fresh).collect()))
    assert {r["path"]: (r["text"], r["mtime"]) for r in store.notes().collect()} == later
    files = lambda n: sorted(map(tuple, VaultIndex(n).files.collect()))
    assert files(store.notes()) == files(frame(later))
    delta = spark.read.parquet(f"file://{tmp_path}/s/data/v2-delta")
    assert {r["path"] for r in delta.filter("reparse").collect()} == {"a/n5.md", "b/new.md"}
    # The first version is still there; a derived table is of its own version.
    assert store.notes(1).count() == 30 and {r["path"] for r in store.notes(1).collect()} == set(rows)
    links = VaultIndex(store.notes(), store=store).links.count()
    store.refresh(frame({}))
    assert store.notes().count() == 0 and VaultIndex(store.notes(), store=store).links.count() == 0 and links == 31
    with pytest.raises(StaleIndex):
        store._commit(meta)
    assert store.vacuum(1) == 2 and store.versions() == [3] and store.notes().count() == 0
