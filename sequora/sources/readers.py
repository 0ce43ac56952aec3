"""Sequence files as DataFrames: spark.read.format("fastq" | "fasta" | "sam" | "vcf" | "fai" | "bam" | "sqar").

Files are found and opened by Spark's own binary reader in ``read_files``, so any store that
Spark can read works and each file is a task. The ``DataSource`` classes serve the short names
over local paths and any store that pyarrow reaches. FASTQ and BAM are read by byte ranges of
at most ``splitBytes``, so one file is many tasks; the others are a partition a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import blocks as B
from . import formats as X
from . import splits
from . import tabix


def _text(parse: Callable) -> Callable[[bytes], Iterator[tuple]]:
    return lambda data: parse(X.bgzf_blocks(data).decode("utf-8", "replace").splitlines())


FORMATS: dict[str, tuple[str, Callable[[bytes], Iterator[tuple]]]] = {
    "fastq": ("id string, sequence string, quality array<int>", _text(X.fastq)),
    "fasta": ("header string, sequence string", _text(X.fasta)),
    "sam": (X.SAM_FIELDS, _text(X.sam)),
    "vcf": (X.VCF_FIELDS, _text(X.vcf)),
    "fai": (X.FAI_FIELDS, _text(X.fai)),
    "bam": (X.SAM_FIELDS, X.bam),
    "sqar": ("block int, offset long, crc32 long, content binary", X.sqar),
}


def parse_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The records of a column that holds whole files (binary or text)."""
    schema, parse = FORMATS[kind]
    names = df.sparkSession.createDataFrame([], schema).columns
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [r for data in batch["__f"] if data is not None for r in parse(bytes(data))]
            yield pd.DataFrame(rows, columns=names)

    from pyspark.sql import functions as F

    return df.select(F.col(column).cast("binary").alias("__f")).mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of all files at ``path`` (a file, a folder or a pattern)."""
    return parse_column(spark.read.format("binaryFile").load(path), "content", kind)


#: Ranges up to which each is a task; of more, runs of neighbours are one task's.
MOST_TASKS = 512


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, header: tuple | None = None):
        self.path, self.start, self.stop, self.header = path, start, stop, header


class _Run(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, most: int):
        self.kind, self.path, self.most = kind, path, most

    def partitions(self):
        out = []
        for path, size in B.listed(self.path):
            cuts, header = [(0, size)], None
            with B.opened(path) as f:
                head = f.read(300)
                if self.kind == "bam" and B.block_size(head):
                    header = splits.bam_header(f)
                    cuts = B.ranges(size, self.most)
                elif self.kind == "fastq" and (B.block_size(head) or head[:2] != b"\x1f\x8b"):
                    cuts = B.ranges(size, self.most)
            out += [_Range(path, a, b, header) for a, b in cuts]
        each = -(-len(out) // MOST_TASKS)
        return [_Run(out[i : i + each]) for i in range(0, len(out), max(each, 1))]

    def read(self, partition):
        for one in partition.ranges:
            yield from self._batches(one) if self.kind == "fastq" else self._rows(one)

    def _batches(self, partition):
        """FASTQ records in Arrow batches: qualities are a byte each until then."""
        names, sequences, qualities, size = [], [], [], 0
        for name, sequence, quality in splits.fastq_lines(self._lines(partition)):
            names.append(name)
            sequences.append(sequence)
            qualities.append(quality)
            size += len(quality)
            if size > 1 << 22:
                yield X.fastq_batch(names, sequences, qualities)
                names, sequences, qualities, size = [], [], [], 0
        if names:
            yield X.fastq_batch(names, sequences, qualities)

    def _lines(self, partition):
        with B.opened(partition.path) as f:
            yield from B.lines(f, partition.start, partition.stop)

    def _rows(self, partition):
        with B.opened(partition.path) as f:
            if partition.header:
                yield from splits.bam_range(f, partition.start, partition.stop, partition.header)
            elif self.kind == "fastq":
                yield from splits.fastq_range(f, partition.start, partition.stop)
            else:
                yield from FORMATS[self.kind][1](f.read())


class _Writer(DataSourceWriter):
    """One file a task, named by the task's attempt; a failed job's files are removed.

    BAM is written in blocks, a row (qname, rname, pos, seq, qual) a record that matches whole;
    ``references`` is its header as "name:length,...".
    """

    def __init__(self, kind: str, path: str, overwrite: bool, references: str = ""):
        self.kind, self.path = kind, path.rstrip("/")
        self.references = [(n, int(size)) for n, _, size in (r.rpartition(":") for r in references.split(",") if r)]
        if overwrite:
            for old, _ in B.listed(self.path):
                if old.rpartition("/")[2].startswith("part-") and old.endswith(f".{kind}"):
                    B.removed(old)

    def _record(self, row) -> bytes:
        if self.kind == "fastq":
            return X.fastq_text(row[0], row[1], list(row[2])).encode()
        if self.kind == "fasta":
            return f">{row[0]}\n{row[1]}\n".encode()
        name, ref, pos, seq, qual = row
        return X.bam_row(name, 0, [n for n, _ in self.references].index(ref), pos - 1, seq, qual)

    def write(self, iterator):
        from pyspark import TaskContext

        context, message = TaskContext.get(), WriterCommitMessage()
        message.name = f"{self.path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.{self.kind}"
        out = B.created(message.name)
        if self.kind == "bam":
            out = B.BgzfWriter(out)
            out.write(X.bam_head(self.references))
        for row in iterator:
            out.write(self._record(row))
        out.close()
        return message

    def abort(self, messages):
        for m in messages:
            if m is not None:
                B.removed(m.name)


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return FORMATS[kind][0]

        def reader(self, schema):
            return _Reader(kind, self.options["path"], int(self.options.get("splitBytes", 64 << 20)))

        def writer(self, schema, overwrite):
            if kind not in ("fastq", "fasta", "bam"):
                raise NotImplementedError(f"{kind} is read only")
            return _Writer(kind, self.options["path"], overwrite, self.options.get("references", ""))

    Source.__name__ = f"{kind.title()}Source"
    return Source


def register(spark: SparkSession) -> None:
    for kind in FORMATS:
        spark.dataSource.register(_source(kind))
    tabix.register(spark)
