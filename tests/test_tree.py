"""The tree source against a plain walk."""

import os
from fnmatch import fnmatchcase

import pytest

from grantscope.sources.project import MANIFEST_SKIP, SOURCE_SKIP
from grantscope.sources.tree import TreeReader, files

FILES = [
    "A.kt", "_B.kt", ".hidden.kt", "notes.txt", "app/C.java", "app/build/D.kt", "app/src/build.kt", "app/src/x/y/z/E.dart", "app/.gradle/F.kt", ".git/G.kt", "node_modules/H.kt", "out/I.kt", "generated/J.kt",
    "lib/[odd] {name}.kt", "lib/émile/K.kt", "lib/generated/L.kt", "lib/AndroidManifest.xml", "lib/.cxx/AndroidManifest.xml", "x y/%41.kt", "deep/" + "d/" * 30 + "M.kt",
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for n, name in enumerate(FILES):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"\xff broken" if name == "_B.kt" else f"text {n} é\n".encode())
    (top / "empty").mkdir()
    return top


def walked(root, names, skip):
    found = {}
    for folder, folders, own in os.walk(root):
        folders[:] = [x for x in folders if not any(fnmatchcase(x, p) for p in skip)]
        for x in own:
            if any(fnmatchcase(x, p) for p in names):
                path = os.path.join(folder, x)
                found[os.path.relpath(path, root)] = open(path, "rb").read().decode("utf-8", "replace")
    return found


@pytest.mark.parametrize(("names", "skip"), [(["*.kt", "*.java", "*.dart"], SOURCE_SKIP), (["AndroidManifest.xml"], MANIFEST_SKIP), (["*"], []), (["*.none"], [])])
def test_files_against_a_walk(spark, root, names, skip):
    for place in (str(root), f"file://{root}", f"{root}/"):
        rows = files(spark, place, names, skip).collect()
        assert {r.relative_path: r.content for r in rows} == walked(root, names, skip) and len({r.relative_path for r in rows}) == len(rows)
        assert all(r.path == f"file://{root}/{r.relative_path}" for r in rows)


def test_the_driver_lists_the_top_folder_only(root):
    reader = TreeReader({"path": f"file://{root}", "names": '["*.kt"]', "skip": '["lib", ".*"]'})
    own = sorted(x.name for x in root.iterdir() if x.is_dir() and x.name != "lib" and not x.name.startswith("."))
    listed = []
    reader._entries, real = lambda fs, folder: listed.append(folder) or real(fs, folder), reader._entries
    assert [p.value for p in reader.partitions()] == [None, *own] and listed == [str(root)]


def test_missing_and_empty_roots(spark, tmp_path):
    assert files(spark, str(tmp_path), ["*"], []).count() == 0
    assert files(spark, str(tmp_path / "none"), ["*"], []).count() == 0
