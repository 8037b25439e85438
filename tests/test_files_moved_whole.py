"""SNK-3, JOB-2: written folders are moved, not made twice; what validated packages take on disk."""

import os

import pyarrow.fs as pafs

from lakeloom.plans import package_job
from lakeloom.sources import files


def _tree(top, names):
    for name in names:
        os.makedirs(os.path.dirname(f"{top}/{name}"), exist_ok=True)
        with open(f"{top}/{name}", "w") as f:
            f.write(name)


def _found(top):
    return sorted(os.path.relpath(f"{d}/{n}", top) for d, _, names in os.walk(top) for n in names)


def test_folders_are_moved_and_merged(tmp_dir):
    top, fs = f"{tmp_dir}/top", pafs.LocalFileSystem()
    os.makedirs(top)
    first, second = ["1/0_a/src/a.txt", "2/0_b/src/a.txt", "c.txt"], ["1/0_a/src/b.txt", "1/1_c/a.txt", "3/x.txt", "c.txt"]
    for own, names in ((f"{tmp_dir}/t1", first), (f"{tmp_dir}/t2", second)):
        _tree(own, names)
        files._show(fs, own, top)
        left = [d for d, _, _ in os.walk(own)]
        # only folders that were shown before are still there, and empty
        assert not _found(own) and sorted(os.path.relpath(d, own) for d in left) == ([".", "1", "1/0_a", "1/0_a/src"] if own.endswith("2") else ["."])
        files._show(fs, own, top)  # a repeated task has nothing left to move
    assert _found(top) == sorted({*first, *second})
    with open(f"{top}/1/0_a/src/b.txt") as f:
        assert f.read() == "1/0_a/src/b.txt"


def test_files_of_a_folder_from_many_tasks(spark, tmp_dir):
    names = [f"k{i % 3}/s{i % 5}/f{i}.bin" for i in range(60)]
    df = spark.createDataFrame([(n, "AAE=") for n in names], "name string, content string").repartition(8)
    files.export_files(df, f"{tmp_dir}/e", "name", "content")
    assert _found(f"{tmp_dir}/e") == sorted(names)
    assert [d for d in os.listdir(tmp_dir) if d != "e"] == []


def test_kept_packages_are_compressed(spark):
    df = spark.createDataFrame([(i, "the same text again " * 500, [{"k": "v"}]) for i in range(50)], "k long, t string, m array<map<string,string>>")
    kept = package_job._kept(df)
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    path = kept.inputFiles()[0].removeprefix("file://")
    assert sum(os.path.getsize(f"{os.path.dirname(path)}/{n}") for n in os.listdir(os.path.dirname(path))) < 50 * 10_000 / 10
