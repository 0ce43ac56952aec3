"""Genomic tables in BGZF with a tabix index: a scan reads only the byte ranges that the index leaves.

``spark.read.format("tabix").load(path)`` has chrom, start, end (from 0, half open) and the
line's fields. Filters on chrom, start and end are pushed: the bins that the region overlaps
name chunks of the file, the linear index says below which place no feature of its first 16 kb
window can lie, and what is left becomes partitions. Lines are checked against the region when
read, and Spark evaluates the filters again, so the index decides the cost and not the result.
A file without a name that the filter asks for is not opened at all.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import blocks as B
from .formats import bgzf_blocks

SCHEMA = "chrom string, start long, end long, fields array<string>"
LONGEST = 1 << 29
WINDOW = 14
BINS = ((1 << 18) - 1) // 7
#: Fixed values of the index format: its magic, the flag for positions from 0, and the VCF layout.
TBI, FROM_ZERO, VCF = b"TBI\1", 0x10000, 2
_LAST = 1 << 63  # a virtual offset past any file


def bins(start: int, end: int) -> Iterator[int]:
    """Every bin that overlaps [start, end): one of 512 Mb, eight of 64 Mb, and so on down to 16 kb."""
    start, end = max(0, start), min(end, LONGEST)
    for level in range(6):
        shift, first = 29 - 3 * level, ((1 << 3 * level) - 1) // 7
        yield from range(first + (start >> shift), first + ((end - 1) >> shift) + 1)


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def aliases(chrom: str) -> list[str]:
    """A reference's name with and without its ``chr``."""
    return [chrom, chrom[3:] if chrom.startswith("chr") else f"chr{chrom}"]


@dataclass
class Reference:
    chunks: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    floors: list[int] = field(default_factory=list)  # the least place of a feature in each 16 kb window


@dataclass
class Index:
    columns: tuple[int, int, int] = (1, 2, 3)  # of name, start and end, from 1; end 0: there is none
    layout: int = FROM_ZERO
    comment: str = "#"
    skip: int = 0
    references: dict[str, Reference] = field(default_factory=dict)

    @staticmethod
    def parse(data: bytes) -> Index:
        data = bgzf_blocks(data)
        if data[:4] != TBI:
            raise ValueError("not a tabix index")
        count, layout, name, begin, end, comment, skip, size = struct.unpack_from("<8i", data, 4)
        names, at = data[36 : 36 + size].decode().split("\0")[:count], 36 + size
        index = Index((name, begin, end), layout, chr(comment), skip)

        def numbers(form: str) -> tuple:
            nonlocal at
            found = struct.unpack_from("<" + form, data, at)
            at += struct.calcsize("<" + form)
            return found

        for name in names:
            here = index.references[name] = Reference()
            for _ in range(numbers("i")[0]):
                which, n = numbers("Ii")
                places = numbers(f"{2 * n}Q")
                if which < BINS:  # what follows the last bin holds counts, not places
                    here.chunks[which] += list(zip(places[::2], places[1::2], strict=True))
            here.floors = list(numbers(f"{numbers('i')[0]}Q"))
        return index

    def bytes(self) -> bytes:
        names = "".join(f"{n}\0" for n in self.references).encode()
        out = [TBI, struct.pack("<8i", len(self.references), self.layout, *self.columns, ord(self.comment), self.skip, len(names)), names]
        for here in self.references.values():
            out.append(struct.pack("<i", len(here.chunks)))
            for which, places in sorted(here.chunks.items()):
                out.append(struct.pack(f"<Ii{2 * len(places)}Q", which, len(places), *(v for c in places for v in c)))
            out.append(struct.pack(f"<i{len(here.floors)}Q", len(here.floors), *here.floors))
        return b"".join(out)

    def add(self, chrom: str, start: int, end: int, begins: int, ends: int) -> None:
        """Enter a line at the virtual offsets [begins, ends); lines come in order of the file."""
        here = self.references.setdefault(chrom, Reference())
        end = max(end, start + 1)
        places = here.chunks[bin_of(start, end)]
        if places and places[-1][1] == begins:
            places[-1] = (places[-1][0], ends)
        else:
            places.append((begins, ends))
        for window in range(start >> WINDOW, ((end - 1) >> WINDOW) + 1):
            while len(here.floors) <= window:
                here.floors.append(begins)

    def ranges(self, chrom: str, start: int = 0, end: int = LONGEST) -> list[tuple[int, int]]:
        """Virtual offsets, merged and in order, where features of [start, end) can lie."""
        here = self.references.get(chrom)
        if here is None or end <= start or start >= LONGEST:
            return []
        window = max(0, start) >> WINDOW
        floor = here.floors[min(window, len(here.floors) - 1)] if here.floors else 0
        asked = here.chunks if start <= 0 and end >= LONGEST else [b for b in bins(start, end) if b in here.chunks]
        merged: list[list[int]] = []
        for first, last in sorted(c for b in asked for c in here.chunks[b] if c[1] > floor):
            first = max(first, floor)
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        return [(a, b) for a, b in merged]

    def places(self) -> list[int]:
        """Places in the file where a line is known to begin."""
        return sorted({p for r in self.references.values() for c in r.chunks.values() for p, _ in c} | {p for r in self.references.values() for p in r.floors if p})

    def row(self, line: str) -> tuple[str, int, int, list[str]] | None:
        """chrom, start, end and fields of a line; None for a comment or a line without them."""
        parts = line.split("\t")
        name, begin, end = self.columns
        if line.startswith(self.comment) or len(parts) < max(self.columns):
            return None
        try:
            start = int(parts[begin - 1]) - (0 if self.layout & FROM_ZERO else 1)
            if self.layout & 0xFFFF == VCF:
                stop = start + len(parts[3])
            else:
                stop = int(parts[end - 1]) if end else start + 1
        except (ValueError, IndexError):
            return None
        return parts[name - 1], start, stop, parts


@dataclass
class Region:
    """What pushed filters leave: names (None: any), and the least start of a window and its end."""

    names: tuple[str, ...] | None = None
    start: int = 0
    end: int = LONGEST

    def narrowed(self, filters) -> Region:
        out = Region(self.names, self.start, self.end)
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "chrom" and isinstance(f, (EqualTo, EqualNullSafe)):
                out.names = tuple(n for n in out.names or (f.value,) if n == f.value)
            elif column == "chrom" and isinstance(f, In):
                out.names = tuple(n for n in out.names or f.value if n in f.value)
            elif column == "start" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):  # starts below `end`
                out.end = min(out.end, f.value + (not isinstance(f, LessThan)))
            elif column == "end" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):  # ends above `start`
                out.start = max(out.start, f.value - (not isinstance(f, GreaterThan)))
            if column == "start" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                out.start = max(out.start, f.value)
            if column == "end" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                out.end = min(out.end, f.value)
        return out

    def holds(self, chrom: str, start: int, end: int) -> bool:
        return (self.names is None or chrom in self.names) and start < self.end and max(end, start + 1) > self.start


@dataclass
class Part(InputPartition):
    path: str
    index: Index  # without its references
    ranges: list[tuple[int, int]]

    def __post_init__(self):
        super().__init__(self.path)


class TabixReader(DataSourceReader):
    def __init__(self, path: str, most: int = 64 << 20):
        self.path, self.most, self.region = path, most, Region()

    def pushFilters(self, filters):  # noqa: N802
        self.region = self.region.narrowed(filters)
        return filters

    def partitions(self) -> list[Part]:
        out = []
        for path, _ in B.listed(self.path, (".tbi",)):
            with B.opened(path + ".tbi") as f:
                index = Index.parse(f.read())
            if self.region == Region():
                found = [(0, _LAST)]
            else:
                names = self.region.names if self.region.names is not None else tuple(index.references)
                found = sorted(r for n in names for r in index.ranges(n, self.region.start, self.region.end))
            known = index.places()
            light = Index(index.columns, index.layout, index.comment, index.skip)
            held: list[tuple[int, int]] = []
            for begins, ends in found:
                while True:  # long ranges are cut where a line is known to begin
                    at = bisect_left(known, begins + (self.most << 16))
                    if at == len(known) or known[at] >= ends:
                        break
                    out.append(Part(path, light, [(begins, known[at])]))
                    begins = known[at]
                if held and (ends >> 16) - (held[0][0] >> 16) >= self.most:  # and short ones share a task
                    out.append(Part(path, light, held))
                    held = []
                held.append((begins, ends))
            if held:
                out.append(Part(path, light, held))
        return out

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where nothing is left to read
            return
        with B.opened(partition.path) as file:
            for begins, ends in partition.ranges:
                yield from self._lines(file, partition.index, begins, ends)

    def _lines(self, file, index: Index, begins: int, ends: int) -> Iterator[tuple]:
        content = B.Inflated(file, begins >> 16)
        place = seen = begins & 0xFFFF
        while True:
            end = content.data.find(b"\n", seen - content.base) if seen >= content.base else -1
            if end < 0:
                seen = max(seen, content.base + len(content.data))
                if content.more():
                    continue
                end = seen - content.base
                if seen <= place:
                    return
            end += content.base
            if (content.block_of(place) << 16 | place - content.marks[0][0]) >= ends:
                return
            row = index.row(content.bytes(place, end - place).decode("utf-8", "replace").removesuffix("\r"))
            if row and self.region.holds(*row[:3]):
                yield row
            place = seen = end + 1
            content.forget(place)


class TabixWriter(DataSourceWriter):
    """A BGZF file and its index a task. Rows must come by (chrom, start), as ``write_indexed`` deals them."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        if overwrite:
            raise NotImplementedError("write to a new folder")

    def write(self, iterator):
        from pyspark import TaskContext

        message, context = WriterCommitMessage(), TaskContext.get()
        message.name = f"{self.path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.gz"
        index, last, out = Index(), None, None
        for chrom, start, end, fields in iterator:
            if last is not None and (chrom != last[0] and chrom in index.references or chrom == last[0] and start < last[1]):
                raise ValueError(f"rows are not in order at {chrom}:{start}")
            out = out or B.BgzfWriter(B.created(message.name))
            begins = out.place
            out.write("\t".join(map(str, (chrom, start, end, *fields))).encode() + b"\n")
            index.add(chrom, start, end, begins, out.place)
            last = chrom, start
        if out is None:
            message.name = None
            return message
        out.close()
        packed = B.BgzfWriter(B.created(message.name + ".tbi"))
        packed.write(index.bytes())
        packed.close()
        return message

    def abort(self, messages):
        for m in messages:
            if m is not None and m.name:
                B.removed(m.name)
                B.removed(m.name + ".tbi")


class TabixSource(DataSource):
    """Options: path; splitBytes, the compressed bytes of a partition (64 MB)."""

    @classmethod
    def name(cls):
        return "tabix"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TabixReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema, overwrite):
        return TabixWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TabixSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_indexed(features: DataFrame, path: str, parts: int | None = None) -> None:
    """Write (chrom, start, end, fields) by ranges of place, a file and its index a task."""
    rows = features.select("chrom", "start", "end", "fields")
    dealt = rows.repartitionByRange(parts, "chrom", "start", "end") if parts else rows.repartitionByRange("chrom", "start", "end")
    dealt.sortWithinPartitions("chrom", "start", "end").write.format("tabix").mode("append").save(path)


def region(spark: SparkSession, path: str, chrom: str, start: int, end: int, **options) -> DataFrame:
    """Features that overlap [start, end) of a reference, whether its name has ``chr`` or not."""
    rows = spark.read.format("tabix").options(**options).load(path)
    return rows.where(F.col("chrom").isin(aliases(chrom)) & (F.col("start") < end) & (F.col("end") > start))
