"""Objects, trees, commits and refs of repositories that git itself made, and of packs made here."""

import hashlib
import os
import random
import shutil
import subprocess

import pytest

from tallyforge.operators import snapshots as N
from tallyforge.sources import git as X

git_there = pytest.mark.skipif(not shutil.which("git"), reason="no git here")


def repository(at):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"} | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "n"), ("EMAIL", "e"))}
    run = lambda *a: subprocess.run(["git", "-C", str(at), *a], env=env, check=True, capture_output=True).stdout.decode()
    at.mkdir()
    run("init", "-q", "-b", "main")
    r = random.Random(1)
    text = [f"line {i} {r.random()}\n" for i in range(3000)]
    for k in range(12):
        text[r.randrange(3000)] = f"changed {k}\n"
        (at / "a" / "b").mkdir(parents=True, exist_ok=True)
        (at / "a" / "b" / "big.txt").write_text("".join(text))
        (at / f"f{k}").write_bytes(os.urandom(50) + b"\0")
        (at / "empty").write_text("")
        run("add", "-A")
        run("-c", "commit.gpgsign=false", "commit", "-q", "-m", f"c{k}", "--date", f"{1700000000 + k} +0000")
    run("branch", "side", "HEAD~3")
    return run


@git_there
@pytest.mark.parametrize("packed", ["loose", "packed", "both", "by name"])
def test_repository(spark, tmp_path, packed):
    run = repository(tmp_path / "r")
    if packed != "loose":
        run("gc", "-q", "--aggressive") if packed != "by name" else run("-c", "repack.useDeltaBaseOffset=false", "repack", "-adfq", "--depth=20")
        run("pack-refs", "--all")
    if packed == "both":
        (tmp_path / "r" / "late").write_text("late")
        run("add", "-A")
        run("commit", "-q", "-m", "late")
    found = X.objects(spark, str(tmp_path / "r" / ".git" / "objects"), part=7)
    got = {r.sha: (r.kind, r.size) for r in found.collect()}
    want = dict((a, (b, int(c))) for a, b, c in (x.split() for x in run("cat-file", "--batch-all-objects", "--batch-check").splitlines()))
    assert got == want and len(got) > 40
    heads = X.refs(spark, str(tmp_path / "r" / ".git"))
    assert {r.ref: r.sha for r in heads.collect()} == dict(reversed(x.split()) for x in run("show-ref").splitlines())
    if packed in ("packed", "loose"):
        trees = {(r.path, r.sha, r.size) for r in X.list_trees(found, heads.filter("ref = 'refs/heads/main'").selectExpr("sha AS commit")).collect()}
        lines = [x.split(maxsplit=4) for x in run("ls-tree", "-r", "-l", "main").splitlines()]
        assert trees == {(x[4], x[2], int(x[3])) for x in lines} and ("a/b/big.txt",) in {t[:1] for t in trees}
        c = X.commits(found)
        parents = c.selectExpr("commit", "at", "explode_outer(parents) AS parent")
        pair = [(1, run("rev-parse", "main").strip(), run("rev-parse", "side").strip())]
        base = N.merge_bases(parents, spark.createDataFrame(pair, "pair_id int, base string, head string")).first().merge_base
        assert base == run("merge-base", "main", "side").strip()


def test_written_packs(spark, tmp_path):
    rows = [("blob", f"text {i}".encode() * (i % 50)) for i in range(300)] + [("blob", b""), ("blob", b"x" * 300_000), ("blob", b"")]
    df = spark.createDataFrame(rows, "kind string, content binary").repartition(3)
    packs = X.write_packs(df, f"file://{tmp_path}/store")
    assert packs.count() == 3 and len(list((tmp_path / "store" / "pack").iterdir())) == 6
    got = {(r.sha, r.kind, bytes(r.content)) for r in X.objects(spark, f"file://{tmp_path}/store", part=10).collect()}
    assert got == {(hashlib.sha1(b"blob %d\0" % len(c) + c).hexdigest(), k, c) for k, c in rows}
    assert X.objects(spark, str(tmp_path)).collect() == []


def test_damage(tmp_path):
    pack, index, _ = X.pack_files([(hashlib.sha1(b"blob 1\0a").digest(), 3, b"a")])
    with pytest.raises(ValueError):
        X.PackIndex(b"no index" + index[8:])
    with pytest.raises(ValueError):
        X.PackIndex(index).offset(b"\1" * 20)
    with pytest.raises(ValueError):
        X.checked("0" * 40, "blob", b"a")
    with pytest.raises(ValueError):
        X.patched(b"abc", bytes([4, 1, 1, 65]))
    assert X.patched(b"abcdef", bytes([6, 5, 0x91, 2, 3, 2, 88, 89])) == b"cdeXY"
