"""WARC archives and their capture index.

Writing: every task writes its rows as WARC 1.1 records, one gzip member each, to archives of bounded size in a shared
folder, and gives for each archive a run: its captures, sorted by URL key, time and id, with their places in the file. Runs are a
written table, each run in order.
Indexing: the runs are cut at the borders of ranges of the sort key, of about RANGE_ROWS captures each, however many there are.
A range's task holds its piece of each run in columns, and a loser tree merges the pieces, of which only a few rows at a time
become objects. The ranges in order are the capture histories of all URLs in order; with the sizes of the ranges each
capture has its position in the whole. A hot URL is cut by time and id like any other range.
Reading: captures of the merged index are read back from their places in the archives, several tasks to a large archive.

Defined cases: a null payload is empty; a null URL has the empty key and no WARC-Target-URI; a null id is written as null and
read back as null, and never is what others refer to; rows that repeat an id are records of their own, and if their payload
is the same as that of the smallest id and so is their id, they are responses; a very long payload is one record; an empty table
gives no archives; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
#: Captures of a range of the index, rows of a run's piece that are objects at once, and bytes of an archive that one task reads.
RANGE_ROWS, ROWS, READ_BYTES = 200_000, 512, 16 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Fixed value: the profile of revisits by equal payload digest in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-capture:"

RUN = "archive string, seq long, url_key string, at long, id long, start long, length long"


#: The parts of a URL in lower case: host without user and www, port, path, query.
URL = r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"
_URL = re.compile(URL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_key(url: str | None) -> str:
    """Host parts reversed and comma-joined, then the path and query, without scheme, user, www and fragment, A-Z in lower case.
    A URL whose host holds a bracket is its own key."""
    low = (url or "").translate(_LOWER)
    host, port, path, query = (x or "" for x in _URL.match(low).groups())
    if not low or "[" in host:
        return low
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path or "/") + (query if len(query) > 1 else "")


def stamp(seconds: int | None) -> str:
    return datetime.fromtimestamp(seconds or 0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(id_: int | None, url: str | None, at: int | None, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    """A record before compression. refers: (id, url, at) of the response that a revisit stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    uri = lambda x: quote(x, safe="!#$%&'()*+,/:;=?@[]~")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{ID}{'null' if id_ is None else id_}>", f"WARC-Date: {stamp(at)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {uri(url)}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers[0]}>", f"WARC-Refers-To-Date: {stamp(refers[2])}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {uri(refers[1])}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of a record; the payload's digest is computed anew where the record holds the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} doesn't hold the payload that it names")
    number = lambda x: None if x is None or (n := x.strip("<>").removeprefix(ID)) == "null" else int(n)
    return {"id": number(fields["WARC-Record-ID"]), "bytes": size, "digest": digest, "type": fields["WARC-Type"], "refers": number(fields.get("WARC-Refers-To"))}


def with_originals(df: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """df (id, url, at, payload) with digest, and o: (id, url, at) of the smallest id with the same payload if that is another.

    Only payloads that come again are joined, by digest; a hot payload is spread by salts or its table broadcast.
    """
    payload = F.coalesce("payload", F.lit(b""))
    rows = df.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    mine = F.when(F.col("id").isNotNull(), F.struct("id", "url", "at"))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min(mine).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = common.join_small_or_salted(rows, common.kept(again, "payloads"), "digest", "id")
    other = F.col("o").isNotNull() & ~F.col("o.id").eqNullSafe(F.col("id"))
    return both.withColumn("o", F.when(other, F.col("o")))


def write(df: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes df (id, url, at, payload, digest, o) to archives in folder and returns their runs.

    An archive gets a name of its own from each attempt at its task, and only the attempt that counts names it in the
    runs, so a task that runs again leaves at most a file that nobody reads.
    """
    common.ready(df.sparkSession)
    rows = df.select("id", "url", "at", "payload", "digest", "o")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, path = common.file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, place, entries = None, "", 0, []

        def close():
            nonlocal out
            out.close()
            out = None
            fs.move(f"{path}/{name}.part", f"{path}/{name}")
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3]))
            cols = list(zip(*entries, strict=True))
            n = len(entries)
            arrays = [pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]]
            entries.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["archive", "seq", "url_key", "at", "id", "start", "length"])

        for b in batches:
            for id_, url, at, payload, digest, o in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}.part", compression=None)
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = z.compress(record(id_, url, at, payload, digest, o and (o["id"], o["url"], o["at"]))) + z.flush()
                out.write(data)
                entries.append((url_key(url), at or 0, id_, place, len(data)))
                place += len(data)
                if place >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return rows.mapInArrow(task, RUN)


def merged(runs: list[Iterable]) -> Iterator:
    """The items of sorted runs in order, by a tree of losers: each inner node holds the run that lost there, and after
    the winner has moved on only the nodes on its way to the root are played again."""
    k, runs = len(runs), [iter(r) for r in runs]
    if k < 2:
        yield from runs[0] if runs else ()
        return
    end = (True,)
    heads = [(False, x) if (x := next(r, end)) is not end else end for r in runs]
    winners, losers = [0] * (2 * k), [0] * k
    winners[k:] = range(k)
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winners[1]
    while not heads[best][0]:
        yield heads[best][1]
        x = next(runs[best], end)
        heads[best] = (False, x) if x is not end else end
        i = (best + k) // 2
        while i:
            if heads[losers[i]] < heads[best]:
                best, losers[i] = losers[i], best
            i //= 2


def _items(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
    """A run's captures in order, a few at a time as objects."""
    for p in sorted(pieces, key=lambda p: p.column(1)[0].as_py()):
        for at in range(0, p.num_rows, ROWS):
            for archive, seq, key, time, id_, start, length in zip(*[c.to_pylist() for c in p.slice(at, ROWS).columns], strict=True):
                yield key, time, id_ is not None, id_ or 0, archive, start, seq, length


def capture_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of written runs in order: runs' columns, part (the range, ranges are in order) and place (in the range)."""
    common.ready(runs.sparkSession)
    ranges = max(1, -(-runs.count() // range_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(ranges, F.col("url_key"), F.col("at"), F.col("id").asc_nulls_first(), F.col("archive"), F.col("start"))
    names = [f.name for f in runs.schema.fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            archives = b.column(0).dictionary_encode()
            for k, archive in enumerate(archives.dictionary.to_pylist()):
                # an archive's captures come from one task, in its run's order
                pieces.setdefault(archive, []).append(b.filter(pa.compute.equal(archives.indices, k)))
        part, place, out = TaskContext.get().partitionId(), 0, []

        def batch():
            key, at, has, id_, archive, start, seq, length = zip(*out, strict=True)
            ids = [i if h else None for h, i in zip(has, id_, strict=True)]
            cols = [pa.array(archive), pa.array(seq, pa.int64()), pa.array(key), *[pa.array(c, pa.int64()) for c in (at, ids, start, length)]]
            n = len(out)
            return pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int32()), pa.array(range(place - n, place), pa.int64())], names=[*names, "part", "place"])

        for item in merged([_items(p) for p in pieces.values()]):
            out.append(item)
            place += 1
            if len(out) == 20_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return dealt.mapInArrow(task, RUN + ", part int, place long")


def positioned(index: DataFrame) -> DataFrame:
    """A written index with position, a capture's place in the whole, from the sizes of the ranges (a row each)."""
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = common.kept(sizes.select(F.col("part").alias("_part"), before.alias("_first")), "ranges")
    first = F.broadcast(first) if common.small(first) else first
    return index.join(first, F.col("part") == F.col("_part")).withColumn("position", F.col("_first") + F.col("place")).drop("_part", "_first")


def read(index: DataFrame, folder: str, carry: tuple[str, ...] = ("url_key", "at", "part", "place")) -> DataFrame:
    """The records of the captures in a written index, from their places in the archives: (id, bytes, digest, type, refers) and
    the index's columns in carry. A task reads READ_BYTES of an archive at most, in the order of the file."""
    spark = common.ready(index.sparkSession)
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    dealt = index.repartition(tasks, F.col("archive"), F.floor(F.col("start") / READ_BYTES)).sortWithinPartitions("archive", "start").select("archive", "start", "length", *carry)
    fields = {"id": "long", "bytes": "long", "digest": "string", "type": "string", "refers": "long"}
    schema = ", ".join(f"{k} {t}" for k, t in [*fields.items(), *((c, index.schema[c].dataType.simpleString()) for c in carry)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = common.file_system(folder)
        name, file = None, None
        for b in batches:
            out = []
            for archive, start, length in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{path}/{archive}")
                file.seek(start)
                out.append(parsed(zlib.decompress(file.read(length), 31)))
            cols = [pa.array([x[k] for x in out], t) for k, t in (("id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[3:]], names=["id", "bytes", "digest", "type", "refers", *carry])
        if file is not None:
            file.close()

    return dealt.mapInArrow(task, schema)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, indexed, and read back through the merged index, each with its URL's key and its position
    in that index. Pages have no capture time: second page_id of 2024 stands for it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select(F.col("page_id").alias("id"), "url", (F.lit(1704067200) + F.coalesce("page_id", F.lit(0))).alias("at"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    folder = common.scratch(spark, "warc")
    runs = common.kept(write(with_originals(rows), folder), "runs")
    index = positioned(common.kept(capture_index(runs), "index"))
    back = read(index, folder, ("position", "url_key"))
    return back.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), "url_key", "position")


#: The URL's key and the position in the merged index by their definitions.
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
u AS (SELECT *, regexp_extract(low, '{URL}', 1) AS host, regexp_extract(low, '{URL}', 2) AS port, regexp_extract(low, '{URL}', 3) AS path, regexp_extract(low, '{URL}', 4) AS query FROM p),
k AS (SELECT page_id, t, CASE WHEN low = '' OR contains(host, '[') THEN low ELSE array_to_string(list_reverse(string_split(host, '.')), ',')
  || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN length(query) > 1 THEN query ELSE '' END END AS url_key FROM u)
SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url_key,
       row_number() OVER (ORDER BY url_key, coalesce(page_id, 0), page_id NULLS FIRST) - 1 AS position
FROM (SELECT page_id, t, url_key, CASE WHEN strlen(t) >= 100 THEN min(page_id) OVER (PARTITION BY t) ELSE page_id END AS first FROM k)
"""
