"""Git objects as tables: loose objects and packs of any store, trees walked, commits and refs; packs written by tasks.

A pack is read in parts of its objects, in the order of their offsets; a delta's base is read from wherever in the pack it is.
Nothing runs git."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyforge.sources.store import materialise

#: Kinds of objects by number, and those of deltas.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_NAME = 6, 7
OBJECTS = "sha string, kind string, size long, content binary"
#: Objects of a part of a pack (about), bytes of a read, and bytes of bases that a part holds.
PART, READ, HELD = 20_000, 1 << 16, 64 << 20


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


def _names(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path)


class PackIndex:
    """An index of version 2: names in order with their offsets."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError("not an index of version 2")
        self.fan = np.frombuffer(raw, ">u4", 256, 8)
        n = self.n = int(self.fan[-1])
        self.names = np.frombuffer(raw, "S20", n, 1032) if n else np.zeros(0, "S20")
        self.raw_names = raw[1032 : 1032 + 20 * n]
        low = np.frombuffer(raw, ">u4", n, 1032 + 24 * n).astype(np.int64)
        far = low >= 1 << 31
        high = np.frombuffer(raw, ">u8", int(far.sum()), 1032 + 28 * n).astype(np.int64) if far.any() else np.zeros(0, np.int64)
        self.offsets = np.where(far, 0, low)
        self.offsets[far] = high[low[far] - (1 << 31)]

    def name(self, i: int) -> bytes:
        return self.raw_names[20 * i : 20 * i + 20]

    def offset(self, name: bytes) -> int:
        lo, hi = (int(self.fan[name[0] - 1]) if name[0] else 0), int(self.fan[name[0]])
        while lo < hi:
            mid = (lo + hi) // 2
            if self.name(mid) < name:
                lo = mid + 1
            else:
                hi = mid
        if lo >= self.n or self.name(lo) != name:
            raise ValueError(f"a delta's base {name.hex()} isn't in its pack")
        return int(self.offsets[lo])


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: copies of ranges and new bytes."""

    def size(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (delta[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if not delta[at - 1] & 128:
                return n, at

    was, at = size(0)
    made, at = size(at)
    if was != len(base):
        raise ValueError("a delta of another base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            start = count = 0
            for k in range(7):
                if op >> k & 1:
                    if k < 4:
                        start |= delta[at] << 8 * k
                    else:
                        count |= delta[at] << 8 * (k - 4)
                    at += 1
            out += base[start : start + (count or 0x10000)]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != made:
        raise ValueError("a delta of another length")
    return bytes(out)


class Pack:
    """Objects of a pack by offset. The last bases are held, up to HELD bytes."""

    def __init__(self, file: pa.NativeFile, index: PackIndex) -> None:
        self.file, self.index = file, index
        self.held: OrderedDict[int, tuple[int, bytes]] = OrderedDict()
        self.bytes = 0
        self.window, self.window_at = b"", 0

    def _read(self, at: int, n: int) -> bytes:
        if not self.window_at <= at < at + n <= self.window_at + len(self.window):
            self.file.seek(at)
            self.window, self.window_at = self.file.read(max(n, READ)), at
        return self.window[at - self.window_at : at - self.window_at + n]

    def _inflated(self, at: int) -> bytes:
        d, out = zlib.decompressobj(), []
        while not d.eof:
            chunk = self._read(at, 4096) or self._read(at, 1)
            if not chunk:
                raise ValueError("a pack that ends within an object")
            out.append(d.decompress(chunk))
            at += len(chunk)
        return b"".join(out)

    def object(self, at: int) -> tuple[int, bytes]:
        """Its kind and content. Chains of deltas are walked without recursion."""
        chain: list[bytes] = []
        start = at
        while True:
            if at in self.held:
                self.held.move_to_end(at)
                kind, content = self.held[at]
                break
            head = self._read(at, 64)
            kind, k = head[0] >> 4 & 7, 1
            while head[k - 1] & 128:
                k += 1
            if kind == BY_OFFSET:
                back = head[k] & 127
                while head[k] & 128:
                    k += 1
                    back = back + 1 << 7 | head[k] & 127
                chain.append(self._inflated(at + k + 1))
                at -= back
            elif kind == BY_NAME:
                chain.append(self._inflated(at + k + 20))
                at = self.index.offset(head[k : k + 20])
            else:
                content = self._inflated(at + k)
                break
        for delta in reversed(chain):
            content = patched(content, delta)
        self.held[start] = (kind, content)
        self.bytes += len(content)
        while self.bytes > HELD and len(self.held) > 1:
            self.bytes -= len(self.held.popitem(last=False)[1][1])
        return kind, content


def checked(name: str, kind: str, content: bytes) -> tuple[str, str, int, bytes]:
    if hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest() != name:
        raise ValueError(f"object {name} has other content")
    return name, kind, len(content), content


class _Part(InputPartition):
    def __init__(self, index: str | None, part: int, parts: int, folder: str | None = None) -> None:
        self.index, self.part, self.parts, self.folder = index, part, parts, folder


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: int) -> None:
        self.path, self.size = path.rstrip("/"), part

    def partitions(self) -> list[InputPartition]:
        store, at = store_of(self.path)
        loose = [x.path for x in _names(store, at) if re.fullmatch(r"[0-9a-f]{2}", x.base_name) and x.type == fs.FileType.Directory]
        out: list[InputPartition] = [_Part(None, 0, 1, x) for x in loose]
        for x in [*_names(store, f"{at}/pack"), *_names(store, at)]:
            if x.base_name.endswith(".idx"):
                parts = max(1, -(-(x.size - 1072) // 28 // self.size))
                out += [_Part(x.path, k, parts) for k in range(parts)]
        return out or [_Part(None, 0, 1)]

    def read(self, p: _Part) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        if p.folder:
            for x in _names(store, p.folder):
                if re.fullmatch(r"[0-9a-f]{38}", x.base_name):
                    with store.open_input_stream(x.path) as f:
                        head, _, content = zlib.decompress(f.read()).partition(b"\0")
                    yield checked(p.folder[-2:] + x.base_name, head.split(b" ")[0].decode(), content)
        elif p.index:
            with store.open_input_stream(p.index) as f:
                index = PackIndex(f.read())
            order = np.argsort(index.offsets, kind="stable")
            with store.open_input_file(p.index[:-4] + ".pack") as f:
                pack = Pack(f, index)
                for i in order[p.part * index.n // p.parts : (p.part + 1) * index.n // p.parts].tolist():
                    kind, content = pack.object(int(index.offsets[i]))
                    yield checked(index.name(i).hex(), KINDS[kind], content)


class GitObjects(DataSource):
    """Format gitobjects: load() of a repository's `objects` folder, or of a folder of packs; option `part`: objects of a partition."""

    @classmethod
    def name(cls) -> str:
        return "gitobjects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("part", PART)))


def objects(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """SC2: (sha, kind, size, content) of every object under `path`, each checked against its name. One that is both loose and
    packed has a row for each."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("gitobjects").option("part", part).load(path)


def tree_entries(found: DataFrame) -> DataFrame:
    """(tree, mode, name, sha) of the tree objects among `found`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tree, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, at = content.as_py(), 0
                while at < len(raw):
                    end = raw.index(b"\0", at)
                    mode, _, name = raw[at:end].partition(b" ")
                    rows.append((tree, mode.decode(), name.decode("utf-8", "replace"), raw[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["tree", "mode", "name", "sha"])

    return found.filter("kind = 'tree'").select("sha", "content").mapInArrow(run, "tree string, mode string, name string, sha string")


def commits(found: DataFrame) -> DataFrame:
    """(commit, tree, parents, at) of the commit objects among `found`; at: the committer's seconds."""
    head = F.split(F.col("content").cast("string"), "\n\n")[0]
    tree = F.regexp_extract(head, "^tree ([0-9a-f]{40})", 1)
    parents = F.regexp_extract_all(head, F.lit("(?m)^parent ([0-9a-f]{40})"), F.lit(1))
    at = F.regexp_extract(head, "(?m)^committer .*> (\\d+)", 1).cast("long")
    return found.filter("kind = 'commit'").select(F.col("sha").alias("commit"), tree.alias("tree"), parents.alias("parents"), at.alias("at"))


def list_trees(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """SC1 over objects and (commit): (commit, path, mode, sha, size): all blobs of each commit, folders walked level by level for
    all at once; links to other repositories are no blobs. A blob that isn't there has size 0."""
    entries = materialise(tree_entries(found).distinct(), "trees")
    level = commits(found).join(wanted.select("commit").distinct(), "commit").select("commit", F.col("tree").alias("at"), F.lit("").alias("prefix")).distinct()
    out = []
    while True:
        below = level.join(entries, level["at"] == entries["tree"]).select("commit", F.concat("prefix", "name").alias("path"), "mode", "sha")
        below = materialise(below, "level")
        out.append(below.filter("mode NOT IN ('40000', '160000')"))
        level = below.filter("mode = '40000'").select("commit", F.col("sha").alias("at"), F.concat("path", F.lit("/")).alias("prefix"))
        if not level.limit(1).count():
            break
    files = out[0]
    for x in out[1:]:
        files = files.unionByName(x)
    sizes = found.filter("kind = 'blob'").select("sha", "size").distinct()
    return files.join(sizes, "sha", "left").select("commit", "path", "mode", "sha", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def refs(spark: SparkSession, path: str) -> DataFrame:
    """SC5, what needs no network: (ref, sha) of a repository's loose and packed refs; a loose one hides a packed one. `path`: the
    repository's own folder. Refs are files that a clone lists at every command: a list of names, read here."""
    store, at = store_of(path.rstrip("/"))
    found: dict[str, str] = {}
    if store.get_file_info(f"{at}/packed-refs").type == fs.FileType.File:
        with store.open_input_stream(f"{at}/packed-refs") as f:
            for line in f.read().decode().splitlines():
                if m := re.fullmatch(r"([0-9a-f]{40}) (\S+)", line):
                    found[m[2]] = m[1]
    for x in store.get_file_info(fs.FileSelector(f"{at}/refs", recursive=True, allow_not_found=True)):
        if x.type == fs.FileType.File:
            with store.open_input_stream(x.path) as f:
                if re.fullmatch(r"[0-9a-f]{40}", text := f.read().decode().strip()):
                    found[x.path[len(at) + 1 :]] = text
    return spark.createDataFrame(sorted(found.items()), "ref string, sha string")


def encoded(kind: int, content: bytes) -> bytes:
    """An object as it stands in a pack."""
    n, head = len(content) >> 4, [kind << 4 | len(content) & 15]
    while n:
        head[-1] |= 128
        head.append(n & 127)
        n >>= 7
    return bytes(head) + zlib.compress(content)


def pack_files(rows: Iterator[tuple[bytes, int, bytes]]) -> tuple[bytes, bytes, str]:
    """A pack and its index of (name, kind, content), and the pack's own name."""
    parts, places, at = [], {}, 12
    for name, kind, content in rows:
        if name not in places:
            raw = encoded(kind, content)
            places[name] = (at, zlib.crc32(raw))
            parts.append(raw)
            at += len(raw)
    body = b"PACK" + struct.pack(">II", 2, len(places)) + b"".join(parts)
    trailer = hashlib.sha1(body).digest()
    names = sorted(places)
    fan = np.cumsum(np.bincount([x[0] for x in names], minlength=256)).astype(">u4").tobytes()
    far = [places[x][0] for x in names if places[x][0] >= 1 << 31]
    low = [places[x][0] if places[x][0] < 1 << 31 else 1 << 31 | far.index(places[x][0]) for x in names]
    index = b"\xfftOc\x00\x00\x00\x02" + fan + b"".join(names) + np.array([places[x][1] for x in names], ">u4").tobytes()
    index += np.array(low, ">u4").tobytes() + np.array(far, ">u8").tobytes() + trailer
    return body + trailer, index + hashlib.sha1(index).digest(), trailer.hex()


#: Bytes of content after which a task begins another pack.
PACK_BYTES = 64 << 20


def write_packs(found: DataFrame, folder: str) -> DataFrame:
    """Objects (kind, content) as packs under `folder`/pack: a task writes one for each PACK_BYTES of content. Packs are named by
    what they hold and moved to their place when whole, so a task that runs again writes the same files. Returns (pack, n)."""
    numbers = {v: k for k, v in KINDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(folder)
        store.create_dir(f"{at}/pack", recursive=True)
        held: list[tuple[bytes, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pack, index, name = pack_files(held)
            for raw, end in ((pack, "pack"), (index, "idx")):
                to = f"{at}/pack/pack-{name}.{end}"
                with store.open_output_stream(f"{to}.tmp-{id(held)}") as f:
                    f.write(raw)
                store.move(f"{to}.tmp-{id(held)}", to)
            n = len({x[0] for x in held})
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["pack", "n"])

        for b in batches:
            for kind, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = content.as_py()
                held.append((hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).digest(), numbers[kind], content))
                size += len(content)
                if size >= PACK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return materialise(found.select("kind", "content").mapInArrow(run, "pack string, n long"), "packs")


def blob_sha(content: str) -> F.Column:
    """The name of a blob of that content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), F.col(content).cast("binary")))
