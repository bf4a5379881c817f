"""Token totals kept up to date by signed deltas.

A store is a folder. A batch is written below a name of its own, ``batches/<batch>-<attempt>``: ``ledger`` has a signed
row for each count that the batch adds or takes away, in buckets of its keys, ``deltas`` their sums by source, language
and tokenizer version. The file ``commits/<batch>`` is made last, at once or not at all, and names the attempt. Totals
add up the deltas of committed batches; they never look at documents again. A batch that is committed already is left
alone, and what a broken or slower attempt left is never read, so that a batch can be sent any number of times, and by
several writers. A commit reads only the buckets that its keys fall into; ``compact`` replaces a long history of batches
by one that says the same.

Writers of different batches take turns: each commit counts from the batches committed before it began.

A change has doc_id, tokenizer, op ('insert', 'revise', 'delete'), seq, source, lang, n_tokens, n_chars; its key is
(doc_id, tokenizer). Defined results: the last change of a key in a batch (by seq, then op and the other values) holds;
an insert of a known key is a revision and a revision of an unknown key an insert; deleting an unknown key does
nothing; null ids, sources and languages are values like others; null counts are 0; other ops and null ops do nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, read_ranks
from .common import by_bytes, map_arrow, private, worker_cache

KEY = ("doc_id", "tokenizer")
GROUP = ("source", "lang", "tokenizer")
ROW = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, n_chars bigint"
SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"
#: Buckets of the ledger: a batch that touches few keys reads few of them.
BUCKETS = 64
#: Files of a bucket that a batch writes at most, so that a large bucket is not one task's.
SPREAD = 4
#: What the names of compactions begin with.
COMPACTED = "compacted-"
CHUNK_CHARS = 1_000_000

#: Tokenizer versions that need no model: what one token is, as a pattern that Java and RE2 read alike.
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[\p{L}\p{M}]+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]+",
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[tokenizer])), F.lit(0)).cast("long")


def with_bpe_counts(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens by a public rank file; null texts have none. A column of that name is replaced."""
    spark = df.sparkSession
    cache, key = worker_cache(), ("ranks", vocabulary)
    if key not in cache:
        cache[key] = read_ranks(vocabulary)
    ranks = spark.sparkContext.broadcast(cache[key])  # a few MB, fixed by the vocabulary
    (own,) = private(df, "text")
    base = df.select(*[c for c in df.columns if c != out], F.col(text).alias(own))
    fields = [f for f in base.schema.fields if f.name != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        held = worker_cache()
        if key not in held or not isinstance(held[key], tiktoken.Encoding):
            held[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        encode = held[key].encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [len(encode(t)) if t else 0 for a, b in by_bytes(texts, CHUNK_CHARS) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], out])

    return map_arrow(base, run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"`{out}` long", key[0])


def changes(docs: DataFrame, op: str, tokenizer: str, seq: int = 0, text: Column | None = None, n_tokens: Column | None = None) -> DataFrame:
    """Change rows for documents (doc_id, source, lang, text); ``n_tokens`` where the tokenizer is no pattern."""
    text = F.col("text") if text is None else text
    none = F.lit(0).cast("long")
    counted = none if op == "delete" else count_tokens(text, tokenizer) if n_tokens is None else n_tokens
    return docs.select(
        "doc_id",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(op).alias("op"),
        F.lit(seq).cast("long").alias("seq"),
        "source",
        "lang",
        counted.alias("n_tokens"),
        (none if op == "delete" else F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("n_chars"),
    )


class Rollup:
    """Totals in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._utils = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def attempts(self) -> dict[str, str]:
        """The committed batches, and the folder of each."""
        at = self._path(f"{self.path}/commits")
        out = {}
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            stream = self._fs.open(s.getPath())
            name = str(self._utils.toString(stream, "UTF-8"))
            stream.close()
            if name:  # a writer that died between making the file and filling it has committed nothing
                out[s.getPath().getName()] = name
        return out

    def committed(self) -> list[str]:
        return sorted(self.attempts())

    def _live(self) -> list[str]:
        """The folders that count: those of batches that no compaction has taken up, and the last compaction."""
        known = self.attempts()
        compact = max((k for k in known if k.startswith(COMPACTED)), default=None)
        if compact is None:
            return sorted(known.values())
        taken = {r.batch for r in self.spark.read.schema("batch string").json(f"{self.path}/batches/{known[compact]}/taken").collect()}
        return sorted(v for k, v in known.items() if k == compact or not (k in taken or k.startswith(COMPACTED)))

    def _read(self, folders: list[str], kind: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/batches/{x}/{kind}") for x in folders]
        while len(parts) > 1:  # a balanced tree of unions, for long histories
            parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + (parts[-1:] if len(parts) % 2 else [])
        return parts[0]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(self.buckets)).cast("int").alias("bucket")

    def state(self, buckets: list[int] | None = None, folders: list[str] | None = None) -> DataFrame:
        """The counts that hold now, one row for each key; of some buckets only, if these are given."""
        ledger = self._read(self._live() if folders is None else folders, "ledger", f"{ROW}, sign int, bucket int")
        if buckets is not None:
            ledger = ledger.where(F.col("bucket").isin(buckets))
        columns = ["doc_id", "tokenizer", "source", "lang", "n_tokens", "n_chars"]
        return ledger.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*columns)

    def _write(self, folder: str, signed: DataFrame) -> None:
        at = f"{self.path}/batches/{folder}"
        signed.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).write.partitionBy("bucket").parquet(f"{at}/ledger")
        written = self.spark.read.schema(f"{ROW}, sign int, bucket int").parquet(f"{at}/ledger")
        written.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars")).write.parquet(f"{at}/deltas")

    def _seal(self, batch: str, folder: str) -> bool:
        """Make the commit file unless there is one; whether this attempt is the one that holds."""
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        at = self._path(f"{self.path}/commits/{batch}")
        if self._fs.exists(at) and batch not in self.attempts():
            self._fs.delete(at, False)
        try:
            out = self._fs.create(at, False)
        except Exception as e:  # py4j wraps what the file system says
            if self._fs.exists(at):
                return False
            raise e
        out.write(bytearray(folder, "utf-8"))
        out.close()
        return self.attempts().get(batch) == folder

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply a batch of changes; False if it was committed before."""
        if not batch or "/" in batch or batch.startswith((".", "_", COMPACTED)):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.attempts():
            return False
        folder, live = f"{batch}-{uuid.uuid4().hex}", self._live()
        kept = rows.where(F.col("op").isin("insert", "revise", "delete"))
        last = kept.groupBy(*KEY).agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens", "n_chars")).alias("c")).select(*KEY, "c.*")
        changed = last.select("doc_id", "tokenizer", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
        if live:
            # written once: it says which buckets are touched, and then what is taken away and added
            at = f"{self.path}/batches/{folder}/changed"
            changed.withColumn("bucket", self._bucket()).write.parquet(at)
            changed = self.spark.read.schema(f"{ROW}, op string, bucket int").parquet(at)
            touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most ``buckets``
            keys = changed.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
            minus = self.state(touched, live).join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("tokenizer").eqNullSafe(F.col("t")), "left_semi")
        plus = changed.where("op <> 'delete'").select("doc_id", "tokenizer", "source", "lang", "n_tokens", "n_chars", F.lit(1).alias("sign"))
        self._write(folder, plus.unionByName(minus.withColumn("sign", F.lit(-1))) if live else plus)
        return self._seal(batch, folder)

    def compact(self) -> bool:
        """Write the state as one batch that stands for all those committed so far; these stay known by name."""
        known, live = self.attempts(), self._live()
        if len(live) < 2:
            return False
        nth = 1 + max((int(k[len(COMPACTED) :]) for k in known if k.startswith(COMPACTED)), default=0)
        batch = f"{COMPACTED}{nth:09d}"
        folder = f"{batch}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(k,) for k in known], "batch string").coalesce(1).write.json(f"{self.path}/batches/{folder}/taken")
        self._write(folder, self.state(folders=live).withColumn("sign", F.lit(1)))
        return self._seal(batch, folder)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars; groups that came to nothing are left out."""
        deltas = self._read(self._live(), "deltas", SUMS)
        return deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")
