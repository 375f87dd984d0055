"""Model-backed maps: contract loop around a pluggable client, resumable generation in micro-batches."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mhqa.operators.keys import ContractError

#: A client is made once a task and maps a request to a reply: both JSON texts.
Client = Callable[[str], str]
ANSWERED = "value string, attempts int, error string, audit array<struct<attempt: int, reply: string, error: string>>"
#: The sink of a stream is partitioned by a hash of the key, so that a batch looks into the folders of its own keys only.
BUCKETS = 64


def strict_object(text: str, fields: dict[str, type]) -> dict[str, Any]:
    """The JSON object of ``text`` with exactly ``fields``, of their types; ValueError for anything else, duplicate keys included. A bool is no int."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("duplicate keys")
        return found

    value = json.loads(text, object_pairs_hook=unique)
    if not isinstance(value, dict) or value.keys() != fields.keys() or any(type(value[k]) is not t for k, t in fields.items()):
        raise ValueError("fields or types differ from the contract")
    return value


def judged(text: str) -> str:
    """The canonical form of a judge's reply; ValueError if it breaks the contract."""
    reply = strict_object(text, {"score": int, "rationale": str, "error_tags": list})
    if not 0 <= reply["score"] <= 100 or not reply["rationale"].strip() or any(not isinstance(t, str) or not t.strip() for t in reply["error_tags"]):
        raise ValueError("score, rationale or tags out of range")
    return json.dumps(reply, ensure_ascii=False, sort_keys=True)


def translated(text: str, *, count: int | None = None) -> str:
    """The canonical form of a translation: {"translation": str}, or {"translations": [str, …]} of ``count`` sentences."""
    if count is None:
        reply = strict_object(text, {"translation": str})
        if not reply["translation"].strip():
            raise ValueError("empty translation")
    else:
        reply = strict_object(text, {"translations": list})
        if len(reply["translations"]) != count or any(not isinstance(s, str) or not s.strip() for s in reply["translations"]):
            raise ValueError("number of sentences differs")
    return json.dumps(reply, ensure_ascii=False, sort_keys=True)


#: How keys and tokens look in messages of clients.
_SECRET = re.compile(r"(?i)\b(?:sk|key|token|bearer)[-_ =:]+[A-Za-z0-9._-]{8,}")


def safe(problem: Exception, limit: int = 500) -> str:
    """The type and message of an error, without keys and line breaks."""
    return re.sub(r"[\r\n]", " ", _SECRET.sub("[redacted]", f"{type(problem).__name__}: {problem}"))[:limit]


class Exhausted(ValueError):
    """No reply met the contract within the allowed attempts."""


class ChatClient:
    """A client over a chat service: ``create`` makes the connection when first asked, ``send`` gets it and the messages and returns the choices, each with content and finish_reason.

    A request is JSON text, a list of messages with role and content. A reply without choice, without text, or cut at the length limit is an error.
    """

    def __init__(self, create: Callable[[], Any], send: Callable[[Any, list[dict[str, str]]], Sequence[dict[str, Any]]]) -> None:
        self.create, self.send = create, send
        self.connection: Any = None

    def __call__(self, request: str) -> str:
        messages = json.loads(request)
        if not isinstance(messages, list) or not messages or any(not isinstance(m, dict) or m.keys() != {"role", "content"} or m["role"] not in ("system", "user", "assistant") or not str(m["content"]).strip() for m in messages):
            raise ValueError("messages need a role and content")
        if self.connection is None:
            self.connection = self.create()
        choices = self.send(self.connection, messages)
        if not choices or not isinstance(choices[0].get("content"), str) or not choices[0]["content"].strip():
            raise ValueError("no text came back")
        if choices[0].get("finish_reason") == "length":
            raise ValueError("the reply is cut at its length limit")
        return choices[0]["content"].strip()


def http_client(url: str, key: str, model: str, *, temperature: float, max_tokens: int, seed: int | None = None, timeout: float = 300.0) -> Callable[[], Client]:
    """Makes clients of a service that speaks the usual chat completion protocol at ``url``; the connection is the standard library's."""

    def make() -> Client:
        from urllib.request import Request, urlopen

        def send(_: Any, messages: list[dict[str, str]]) -> list[dict[str, Any]]:
            body = {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, "response_format": {"type": "json_object"}, **({} if seed is None else {"seed": seed})}
            request = Request(f"{url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urlopen(request, timeout=timeout) as reply:  # noqa: S310 - the address was checked to be http(s)
                choices = json.load(reply)["choices"]
            return [{"content": c["message"].get("content"), "finish_reason": c.get("finish_reason")} for c in choices]

        return ChatClient(lambda: None, send)

    return make


def attempts_of(text: str | None, client: Callable[[], Client], accept: Callable[[str], str], retries: int) -> tuple[str | None, int, str | None, list[dict[str, Any]]]:
    """(accepted reply, attempts, error, audit): one call after another until a reply is accepted; the audit has each attempt's reply and error."""
    if text is None:
        return None, 0, "null request", []
    audit: list[dict[str, Any]] = []
    for n in range(1, retries + 2):
        reply = None
        try:
            reply = client()(text)
            value = accept(reply)
        except Exception as problem:  # noqa: BLE001 - whatever a client raises becomes part of the row
            audit.append({"attempt": n, "reply": None if reply is None else _SECRET.sub("[redacted]", reply)[:10_000], "error": safe(problem)})
        else:
            audit.append({"attempt": n, "reply": reply, "error": None})
            return value, n, None, audit
    return None, retries + 1, safe(Exhausted(audit[-1]["error"])) if any(a["reply"] is not None for a in audit) else audit[-1]["error"], audit


def in_order(items: Iterable[str | None], work: Callable[[str | None], Any], workers: int) -> Iterator[Any]:
    """``work`` of each item, in their order, with at most twice as many begun as there are workers."""
    with ThreadPoolExecutor(workers) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(work, item))
            if len(waiting) >= 2 * workers:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def model_map(requests: DataFrame, key: str, request: str, make_client: Callable[[], Client], accept: Callable[[str], str], *, retries: int = 2, workers: int = 1, rows: int = 256) -> DataFrame:
    """(key, value, attempts, error, audit): the accepted reply to each request, or the last error after ``retries`` more attempts. Failed rows stay in the result, in the order of the input.

    A task makes one client when first needed and keeps ``workers`` requests going; results leave it every ``rows``. Requests that are null aren't sent. Messages of errors are
    stored without keys. ``audit`` is private: keep it apart from what is published.
    """
    kind = dict(requests.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[Client] = []
        lock = Lock()

        def client() -> Client:
            with lock:
                if not made:
                    made.append(make_client())
                return made[0]

        for batch in batches:
            answers = in_order(batch[1].to_pylist(), lambda text: attempts_of(text, client, accept, retries), workers)
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                values, attempts, errors, audits = zip(*[next(answers) for _ in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays([part[0], pa.array(values, pa.string()), pa.array(attempts, pa.int32()), pa.array(errors, pa.string()), pa.array(audits, _AUDIT)], names=[key, "value", "attempts", "error", "audit"])

    return requests.select(key, request).mapInArrow(run, f"`{key}` {kind}, {ANSWERED}")


_AUDIT = pa.list_(pa.struct([("attempt", pa.int32()), ("reply", pa.string()), ("error", pa.string())]))


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is nothing; a table that can't be read is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def resume(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], *, key: str, signature: str, files_per_batch: int = 100) -> int:
    """Appends ``build`` of all rows of the JSON directory ``source`` whose key the sink lacks; the number of micro-batches that wrote.

    Runs as a stream over what is there now and ends. Checkpoints remember the files; the anti-join on the key makes a repeated batch harmless. The sink
    keeps ``signature``; rows of another one are a ContractError.
    """
    batches = 0
    if (old := existing(spark, sink)) is not None and old.where(~F.col("signature").eqNullSafe(F.lit(signature))).limit(1).count():
        raise ContractError("the sink holds rows of another configuration")
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, _: int) -> None:
        nonlocal batches
        wanted = batch.dropDuplicates([key]).withColumn("bucket", bucket)
        if (done := existing(spark, sink)) is not None:
            touched = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most BUCKETS numbers; other folders of the sink aren't read
            wanted = wanted.join(done.where(F.col("bucket").isin(touched)).select(key, "bucket"), [key, "bucket"], "left_anti")
        build(wanted.drop("bucket")).withColumns({"signature": F.lit(signature), "bucket": bucket}).write.mode("append").partitionBy("bucket").parquet(sink)
        batches += 1

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return batches
