"""Problem 2: records that differ in formatting only, kept in an incremental ledger of canonical keys."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.session import checkpoint_folder, cut, width

BUCKETS = 64  # of a new ledger; an existing one keeps the number it was made with
NEVER = "9999-12-31"  # when a record without a time was seen
PARTS = ("authors", "title", "journal", "booktitle", "publisher", "url", "doi", "isbn")
WORD = re.compile(r"[^\W_]+")
#: labels and the numbers that belong to them
ARITY = {"stand": 3, "s": 2, "pp": 2, "p": 2, "pages": 2, "vol": 1, "jg": 1, "band": 1, "no": 1, "nr": 1, "heft": 1, "ca": 1, "sign": 1}


def folded(text: str) -> tuple[str, list[int]]:
    """Letters and digits of a text without case, and the place of each in the text."""
    low = text.casefold()
    if len(low) == len(text):
        at = [i for i, c in enumerate(low) if c.isalnum()]
        return "".join([low[i] for i in at]), at
    out, at = [], []
    for i, c in enumerate(text):
        for x in c.casefold():
            if x.isalnum():
                out.append(x)
                at.append(i)
    return "".join(out), at


def canonical(raw: str | None, parts: list[str | None], pages: str | None = None) -> str:
    """The printed parts of an entry as letters and digits only, in sorted order.

    ``parts`` are the field values that the parser took from the entry; each is
    cut out of ``raw`` where it stands, longest first. What remains (labels,
    numbers, dates, identifiers) is grouped by label. Case, white space,
    punctuation and the order of the parts do not matter; the order inside
    a part does. Null and blank texts have an empty key.
    """
    if not raw:
        return ""
    flat, at = folded(raw)
    left = list(raw)
    found = []
    for p in sorted({f for f in (folded(p)[0] for p in parts if p) if f}, key=lambda f: (-len(f), f)):
        k = flat.find(p)
        if k < 0:
            continue
        found.append(p)
        for i in range(k, k + len(p)):
            left[at[i]] = "\0"
        flat = flat[:k] + "\0" * len(p) + flat[k + len(p) :]
    # a number of pages of 0 means that the parser saw none
    n_pages = len(WORD.findall(pages)) if pages else 2
    words = WORD.findall("".join(c if c != "\0" else " " for c in left).casefold())
    groups: list[list[str]] = []
    room = 0
    for w in words:
        if not any(c.isdigit() for c in w):
            groups.append([w])
            room = min(ARITY.get(w, 0), n_pages) if w in ("s", "pp", "p", "pages") else ARITY.get(w, 0)
        elif room:
            groups[-1].append(w)
            room -= 1
        else:
            groups.append([w])
    return "|".join(sorted(found)) + "#" + "|".join(sorted("".join(g) for g in groups))


def keyed(entries: DataFrame, ident: str = "entry_id", when: str = "loaded_at") -> DataFrame:
    """``ident, seen_at, key`` of each row: the key is 128 bits of the SHA-256 of the canonical form.

    Columns the table lacks count as null. Rows without a text share no key
    with any other row: their key is made of their id.
    """
    cols = [c for c in ("raw_text", "pages", *PARTS)]
    have = set(entries.columns)
    kind = entries.schema[ident].dataType.simpleString()
    src = entries.select(F.col(ident).alias("ident"), (F.col(when) if when in have else F.lit(None)).cast("timestamp").alias("seen_at"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in cols])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys = []
            for who, raw, pages, *parts in zip(b["ident"], b["raw_text"], b["pages"], *[b[p] for p in PARTS], strict=True):
                form = canonical(raw, parts, pages)
                keys.append(hashlib.sha256((form if form.strip("#") else f"\0{who}").encode("utf-8", "replace")).hexdigest()[:32])
            yield pd.DataFrame({"ident": b["ident"], "seen_at": b["seen_at"], "key": keys})

    return src.mapInPandas(run, f"ident {kind}, seen_at timestamp, key string")


class CopyLedger:
    """Counts of canonical keys over all batches seen, kept in buckets in a shared folder.

    A row holds ``bucket, key, n_copies, first_id, earliest_id, first_seen``:
    the number of copies, the smallest id, and the earliest record (of equally
    early ones the smallest id; records without a time come last). Each update
    aggregates its batch (a key that holds a third of the rows leaves each
    task as one row), reads the buckets that the batch touches and no others,
    joins them in a full outer join, adds the counts and writes the touched
    buckets anew; a list of the folder of each bucket, replaced last, makes the
    update whole or void. A batch must hold each record once, and none that an
    earlier batch held.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self.fs = fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = fs.Path
        self.state: dict = {"buckets": buckets, "version": 0, "at": {}}
        if self.fs.exists(self.path(f"{self.folder}/state")):
            newest = max(int(f.getPath().getName()) for f in self.fs.listStatus(self.path(f"{self.folder}/state")))
            self.state = json.loads(spark.read.text(f"{self.folder}/state/{newest}", wholetext=True).first()[0])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.state["buckets"])).cast("int")

    def load(self, touched: list[int] | None = None) -> DataFrame | None:
        """The rows of some buckets, or of all; None if there are none yet."""
        at = [f"{self.folder}/{v}/b={b}" for b, v in self.state["at"].items() if touched is None or int(b) in touched]
        return self.spark.read.parquet(*at) if at else None

    def update(self, batch: DataFrame) -> list[int]:
        """Adds a batch of ``ident, seen_at, key``; returns the buckets read and written."""
        kind = batch.schema["ident"].dataType.simpleString()
        seen = F.struct(F.coalesce("seen_at", F.lit(NEVER).cast("timestamp")).alias("first_seen"), F.col("ident").alias("earliest_id"))
        new = batch.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("ident").alias("first_id"), F.min(seen).alias("e"))
        new = cut(new.select(self.bucket().alias("bucket"), "key", "n_copies", "first_id", "e.earliest_id", "e.first_seen"))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if not touched:
            return []
        old = self.load(touched)
        if old is not None:
            a, b = new.alias("a"), old.alias("b")
            early = F.least(*[F.when(F.col(f"{t}.key").isNotNull(), F.struct(F.col(f"{t}.first_seen"), F.col(f"{t}.earliest_id"))) for t in "ab"])
            both = a.join(b.hint("merge"), ["bucket", "key"], "full_outer")
            n = F.coalesce("a.n_copies", F.lit(0)) + F.coalesce("b.n_copies", F.lit(0))
            both = both.select("bucket", "key", n.alias("n_copies"), F.least("a.first_id", "b.first_id").alias("first_id"), early.alias("e"))
            new = both.select("bucket", "key", "n_copies", "first_id", F.col("e.earliest_id").cast(kind).alias("earliest_id"), "e.first_seen")
        v = self.state["version"] + 1
        new.withColumn("b", F.col("bucket")).repartition(min(len(touched), width(new)), "bucket").write.mode("overwrite").partitionBy("b").parquet(f"{self.folder}/{v}")
        self.state = {"buckets": self.state["buckets"], "version": v, "at": self.state["at"] | {str(b): v for b in touched}}
        out = self.fs.create(self.path(f"{self.folder}/state/{v}"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        return touched


def ledger_of(entries: DataFrame, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """Keys of all entries, and the rows of a new ledger after all batches.

    Entries come in ``batches`` deliveries, by the month of their arrival
    (rows without a time in the first). An id counts once, by its first
    delivery; the order of the batches does not change the ledger.
    """
    cols = [c for c in ("entry_id", "raw_text", "pages", *PARTS, "loaded_at") if c in entries.columns]
    once = entries.select(*cols).repartition(width(entries), "entry_id")
    rest = [F.first(c).alias(c) for c in cols if c not in ("entry_id", "loaded_at")]
    once = once.groupBy("entry_id").agg(*rest, *([F.min("loaded_at").alias("loaded_at")] if "loaded_at" in cols else []))
    keys = cut(keyed(once))
    part = F.coalesce(F.pmod(F.month("seen_at"), F.lit(batches)), F.lit(0))
    ledger = CopyLedger(entries.sparkSession, f"{checkpoint_folder(entries.sparkSession)}/ledger-{uuid.uuid4()}")
    for i in range(batches):
        ledger.update(keys.where(part == i))
    rows = ledger.load()
    return keys, rows if rows is not None else keys.where("false").selectExpr("0 bucket", "key", "1L n_copies", "ident first_id", "ident earliest_id", "seen_at first_seen")


def found(entries: DataFrame) -> DataFrame:
    """Each copy with the smallest id of its group; a group's smallest id has no row."""
    keys, ledger = ledger_of(entries)
    groups = ledger.where("n_copies > 1").select("key", F.col("first_id").alias("first_entry_id"))
    return keys.join(groups.hint("merge"), "key").where("ident != first_entry_id").select("first_entry_id", F.col("ident").alias("entry_id"))


def distinct_references(entries: DataFrame) -> DataFrame:
    """Each distinct reference once: its earliest representative and the number of copies. ``first_seen`` is null where no copy has a time."""
    _, ledger = ledger_of(entries)
    return ledger.select(F.col("earliest_id").alias("entry_id"), "n_copies", F.when(F.col("first_seen") < F.lit(NEVER).cast("timestamp"), F.col("first_seen")).alias("first_seen"))
