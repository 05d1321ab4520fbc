import os

from shelfmark.sources import listing as L


def kinds(df):
    return sorted((r["kind"], r["path"]) for r in df.collect())


def test_walk_finds_files_folders_links_and_errors(spark, tmp_path):
    lib = tmp_path / "lib"
    (lib / "a" / "b" / "c").mkdir(parents=True)
    (lib / "empty").mkdir()
    (lib / ".quarantine" / "x").mkdir(parents=True)
    for name in ("top.zip", "a/one.zip", "a/b/c/deep #1 %20é.zip", ".quarantine/x/old.zip", "a/.hidden"):
        (lib / name).write_bytes(b"12345")
    os.symlink(lib / "a", lib / "loop")
    os.symlink(lib / "top.zip", lib / "again.zip")
    roots = [str(lib), str(tmp_path / "gone"), str(lib / "top.zip")]
    seen = L.walk(spark, roots)
    files = {f"{lib}/{n}" for n in ("top.zip", "a/one.zip", "a/b/c/deep #1 %20é.zip", "a/.hidden")}
    assert {p for k, p in kinds(seen) if k == "file"} == files
    assert {p for k, p in kinds(seen) if k == "folder"} == {f"{lib}/{n}" for n in ("a", "a/b", "a/b/c", "empty")}
    bad = {r["path"]: r["error"] for r in L.unreadable(seen).collect()}
    assert set(bad) == {str(tmp_path / "gone"), str(lib / "top.zip")} and all(bad.values())
    assert {r["path"] for r in L.walk(spark, roots[:1], include_quarantine=True).where("kind = 'file'").collect()} == files | {f"{lib}/.quarantine/x/old.zip"}
    listed = {r["path"]: r for r in L.listed(seen).collect()}
    one = listed[f"{lib}/a/one.zip"]
    assert (one["rel"], one["name"], one["size"], one["root"]) == ("a/one.zip", "one.zip", 5, str(lib))
    assert abs(one["modified"].timestamp() - os.stat(lib / "a/one.zip").st_mtime) < 1


def test_a_folder_that_goes_meanwhile_is_an_error_row(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"root_ord": [0, 0], "root": ["r", "r"], "path": [str(tmp_path / "went"), str(tmp_path)]})
    (tmp_path / "f.zip").write_bytes(b"")
    rows = [r for b in L._entries(iter([batch]), False, L.QUARANTINE) for r in b.to_pylist()]
    assert [(r["kind"], r["size"]) for r in rows] == [("error", None), ("file", 0)]
