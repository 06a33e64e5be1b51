"""Stored models: versioned Parquet directories behind a pointer, with expiry, tags and snapshots.

Layout: ``<root>/<key>/v-<time>-<uuid>/{transitions,sequence_freq,records}`` and an append-only log of
pointers ``<root>/<key>/log``, whose newest entry is current. A version is complete before its entry
is written, so readers never see half of one.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Mapping
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelet.operators.model import Model, with_probability

LOG = "entry string, version string, kind_order int, meta string, stored_at timestamp, expires_at timestamp, tag string"


class Storage(Protocol):
    def put(self, key: str, model: Model, ttl: int | None = None, as_of: datetime | None = None, meta: Mapping | None = None, records: DataFrame | None = None) -> None: ...

    def get(self, key: str, as_of: datetime | None = None) -> Model | None: ...

    def forget(self, key: str) -> None: ...


class ParquetStore:
    """The store for files and tables alike."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        """A folder of the key's own: what can be read of it, and its digest."""
        return f"{self.root}/{re.sub(r'[^A-Za-z0-9_.-]', '_', key)[:80]}-{hashlib.sha256(key.encode()).hexdigest()[:16]}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _log(self, key: str, entry: str, version: str, order: int, meta: str, at: datetime, expires: datetime | None, tag: str | None) -> None:
        self.spark.createDataFrame([(entry, version, order, meta, at, expires, tag)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path(key)}/log")

    def entries(self, key: str) -> DataFrame | None:
        where = f"{self.path(key)}/log"
        return self.spark.read.schema(LOG).parquet(where) if self._exists(where) else None

    def put(self, key: str, model: Model, ttl: int | None = None, as_of: datetime | None = None, meta: Mapping | None = None, records: DataFrame | None = None) -> None:
        at = as_of or datetime.now()
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"  # of two stored at the same time the one written later is the newer
        base = f"{self.path(key)}/{version}"
        model.transitions.write.parquet(f"{base}/transitions")
        model.sequence_freq.write.parquet(f"{base}/sequence_freq")
        if records is not None:
            records.write.parquet(f"{base}/records")
        self._log(key, "put", version, model.order, json.dumps(dict(meta or {}), default=str), at, at + timedelta(seconds=ttl) if ttl else None, None)

    def _current(self, key: str, as_of: datetime | None, tag: str | None = None):
        rows = self.entries(key)
        if rows is None:
            return None
        # an expired entry is as good as none; nothing older comes back in its place
        rows = rows.where(F.col("tag") == tag) if tag else rows.where("entry = 'put'")
        newest = rows.orderBy(F.desc("stored_at"), F.desc("version")).limit(1).collect()
        if not newest or newest[0]["version"] in self._forgotten(key) and not tag or (newest[0]["expires_at"] and newest[0]["expires_at"] <= (as_of or datetime.now())):
            return None
        return newest[0]

    def get(self, key: str, as_of: datetime | None = None, tag: str | None = None, password: str | None = None) -> Model | None:
        """The current model, or the one kept under a tag; ``password``: that of an encrypted snapshot."""
        row = self._current(key, as_of, tag)
        if row is None:
            return None
        kept = json.loads(row["meta"]) if tag else {}
        if kept.get("payload"):
            if kept["encrypted"] and password is None:
                raise ValueError(f"the snapshot {tag} of {key} needs a password")
            pairs = read_lines(self.spark, f"{kept['payload']}/transitions", "prefix string, token string, cnt bigint", password if kept["encrypted"] else None)
            return Model(row["kind_order"], with_probability(pairs), read_lines(self.spark, f"{kept['payload']}/sequence_freq", "sequence string, n bigint", password if kept["encrypted"] else None))
        base = f"{self.path(key)}/{row['version']}"
        return Model(row["kind_order"], self.spark.read.parquet(f"{base}/transitions"), self.spark.read.parquet(f"{base}/sequence_freq"))

    def records(self, key: str, as_of: datetime | None = None) -> DataFrame | None:
        row = self._current(key, as_of)
        where = f"{self.path(key)}/{row['version']}/records" if row else ""
        return self.spark.read.parquet(where) if row and self._exists(where) else None

    def meta(self, key: str, as_of: datetime | None = None) -> dict | None:
        row = self._current(key, as_of)
        return json.loads(row["meta"]) if row else None

    def _forgotten(self, key: str) -> set[str]:
        return {r["version"] for r in self.entries(key).where("entry = 'forget'").select("version").distinct().collect()}

    def forget(self, key: str) -> None:
        """Take all versions away but those kept under a tag, which stay reachable by it."""
        rows = self.entries(key)
        if rows is None:
            return
        tagged = {r["version"] for r in rows.where("tag IS NOT NULL").select("version").distinct().collect()}
        if not tagged:
            self._delete(self.path(key))
            return
        for r in rows.where("entry = 'put'").select("version", "kind_order").distinct().collect():  # a row for each time the model was stored
            self._log(key, "forget", r["version"], r["kind_order"], "{}", datetime.now(), None, None)
            if r["version"] not in tagged:
                self._delete(f"{self.path(key)}/{r['version']}")

    def _size(self, path: str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def snapshots(self, key: str) -> DataFrame:
        """What is kept of a model: tag, description, whether compressed or encrypted, sizes in bytes, and when."""
        rows = self.entries(key)
        if rows is None:
            rows = self.spark.createDataFrame([], LOG)
        kept = F.from_json("meta", "description string, compressed boolean, encrypted boolean, original_size bigint, stored_size bigint")
        return rows.where("entry = 'snapshot'").select(F.lit(key).alias("model_key"), "tag", kept.alias("k"), F.col("stored_at").alias("created_at")).select("model_key", "tag", "k.*", "created_at")

    def snapshot(self, key: str, tag: str, description: str | None = None, as_of: datetime | None = None, codec: str | None = None, password: str | None = None) -> None:
        """Keep the current version under a tag that is unique for the model.

        Versions never change, so nothing is copied, unless it is to be compressed (``codec``) or
        encrypted (``password`` of 16, 24 or 32 bytes): then counts and sequences are written as lines
        of JSON, each encrypted by itself, from which ``get`` makes the model again.
        """
        row = self._current(key, as_of)
        if row is None:
            raise ValueError(f"there is no model {key}")
        log = self.entries(key)
        if log.where(F.col("tag") == tag).limit(1).count():
            raise ValueError(f"{key} has a snapshot {tag} already")
        base, payload = f"{self.path(key)}/{row['version']}", None
        if codec or password:
            payload = f"{self.path(key)}/kept-{uuid.uuid4().hex}"
            model = self.get(key, as_of)
            for name, table in (("transitions", model.transitions.select("prefix", "token", "cnt")), ("sequence_freq", model.sequence_freq.select("sequence", "n"))):
                table.select(line(F.to_json(F.struct("*")), password).alias("value")).write.option("compression", codec or "none").text(f"{payload}/{name}")
        facts = {"description": description, "compressed": bool(codec), "encrypted": bool(password), "original_size": self._size(base), "stored_size": self._size(payload or base), "payload": payload}
        self._log(key, "snapshot", row["version"], row["kind_order"], json.dumps(facts), as_of or datetime.now(), None, tag)

    def export(self, key_or_model: str | Model, path: str, codec: str = "gzip", password: str | None = None) -> None:
        """A model as JSON lines, one a prefix; with a password (16, 24 or 32 bytes) each line is encrypted and base64."""
        model = self.get(key_or_model) if isinstance(key_or_model, str) else key_or_model
        if model is None:
            raise ValueError(f"there is no model {key_or_model}")
        rows = nested(model).select(line(F.to_json(F.struct("prefix", "tokens")), password).alias("value"))
        rows.write.mode("overwrite").option("compression", codec).text(path)


def line(text: Column, password: str | None) -> Column:
    """A line as it is written: with a password encrypted and in base64."""
    return F.translate(F.base64(F.aes_encrypt(text, F.lit(password))), "\r\n", "") if password else text


def read_lines(spark: SparkSession, path: str, schema: str, password: str | None) -> DataFrame:
    value = F.aes_decrypt(F.unbase64("value"), F.lit(password)).cast("string") if password else F.col("value")
    return spark.read.text(path).select(F.from_json(value, schema).alias("r")).select("r.*")


class SessionStore:
    """Models kept for the session with their records and what is said about them, cached while they are valid."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[Model, datetime | None]] = {}
        self.beside: dict[str, tuple[DataFrame | None, dict]] = {}

    def put(self, key: str, model: Model, ttl: int | None = None, as_of: datetime | None = None, meta: Mapping | None = None, records: DataFrame | None = None) -> None:
        held = Model(model.order, model.transitions.persist(), model.sequence_freq.persist())
        self.forget(key)
        self.kept[key] = held, (as_of or datetime.now()) + timedelta(seconds=ttl) if ttl else None
        self.beside[key] = (None if records is None else records.persist()), dict(meta or {})

    def records(self, key: str, as_of: datetime | None = None) -> DataFrame | None:
        return self.beside[key][0] if self.get(key, as_of) is not None else None

    def meta(self, key: str, as_of: datetime | None = None) -> dict | None:
        return self.beside[key][1] if self.get(key, as_of) is not None else None

    def get(self, key: str, as_of: datetime | None = None) -> Model | None:
        model, expires = self.kept.get(key, (None, None))
        if model is not None and expires and expires <= (as_of or datetime.now()):
            self.forget(key)
            return None
        return model

    def forget(self, key: str) -> None:
        model, _ = self.kept.pop(key, (None, None))
        records, _ = self.beside.pop(key, (None, {}))
        for held in (model.transitions, model.sequence_freq, records) if model is not None else ():
            if held is not None:
                held.unpersist()


def nested(model: Model) -> DataFrame:
    """One row for each prefix: its tokens with probability and running probability."""
    from tracelet.operators.model import cumulative

    rows = cumulative(model.transitions)
    return rows.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("token", "probability", "cumulative"))).alias("tokens"))


def export_model(model: Model, path: str) -> None:
    nested(model).withColumn("order", F.lit(model.order)).write.mode("overwrite").json(path)


def valid(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Entries that have not expired."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))
