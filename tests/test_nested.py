from shelfmark.operators import nested

SCHEMA = "archive string, node bigint, parent bigint, name string, is_dir boolean"


def outputs(spark, rows, **how):
    return {(r["archive"], r["node"]): (r["level"], r["path"], r["error"]) for r in nested.nested_outputs(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def test_wrappers_add_no_folder_and_archives_add_their_stem(spark):
    got = outputs(spark, [
        ("x", 1, None, "box/wrap.zip", False), ("x", 2, 1, "in/Title v1.cbz", False), ("x", 3, 2, "p 1.jpg", False), ("x", 4, 2, "p.2.jpg", False), ("x", 5, 2, "empty/", True),
        ("y", 1, None, "r/a.zip", False), ("y", 2, None, "r/b.jpg", False), ("y", 3, 1, "c.rar", False), ("y", 4, 1, "d.7z", False), ("y", 5, 3, "../out.jpg", False), ("y", 6, 3, "ok.jpg", False),
        ("z", 1, None, "only.7z", False), ("z", 2, 9, "lost.jpg", False), ("z", 3, 4, "loop.zip", False), ("z", 4, 3, "loop2.zip", False), ("z", 5, 4, "round.jpg", False),
    ])
    assert got == {
        # The one archive of x is a wrapper, and so is what it holds, so neither gives its name.
        ("x", 3): (2, "in/p 1.jpg", None), ("x", 4): (2, "in/p.2.jpg", None),
        ("y", 2): (0, "b.jpg", None), ("y", 4): (1, None, "unsupported archive"), ("y", 5): (2, None, "unsafe path"), ("y", 6): (2, "a/c/ok.jpg", None),
        ("z", 1): (0, None, "unsupported archive"), ("z", 2): (None, None, "unknown container"), ("z", 5): (None, None, "too deep"),
    }


def test_depth_limit(spark):
    rows = [("a", k, k - 1 if k else None, f"l{k}.zip", False) for k in range(12)] + [("a", 100 + k, k, f"m{k}.jpg", False) for k in range(12)]
    got = outputs(spark, rows)
    for k in range(12):
        path = "/".join([f"l{j}" for j in range(1, k + 1)] + [f"m{k}.jpg"])  # l0.zip is alone at the top
        assert got[("a", 100 + k)] == ((k + 1, path, None) if k < 8 else (k + 1, None, "too deep"))
    assert outputs(spark, []) == {}
