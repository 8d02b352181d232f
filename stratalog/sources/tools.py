"""Tools of a child process that speaks JSON-RPC 2.0, a message a line, as a source of rows."""

from __future__ import annotations

import json
import os
import selectors
import subprocess
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version of the protocol and names of the tools.
PROTOCOL = "2024-11-05"
TRANSCRIPT, METADATA, VIDEOS, CREATORS = "get_video_transcript", "get_video_metadata", "search_bilibili_videos", "search_bilibili_creators"


class ToolProcess:
    """A child process from its handshake to its end; answers are matched by id, other messages are passed over."""

    def __init__(self, command: list[str], timeout: float):
        self.timeout, self.sent, self.buffer = timeout, 0, b""
        self.child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.ready = selectors.DefaultSelector()
        self.ready.register(self.child.stdout, selectors.EVENT_READ)
        try:
            self.ask("initialize", {"protocolVersion": PROTOCOL, "capabilities": {}, "clientInfo": {"name": "stratalog", "version": "1"}})
        except BaseException:
            self.close()
            raise

    def _line(self, until: float) -> bytes:
        while b"\n" not in self.buffer:
            if not self.ready.select(max(0.0, until - time.monotonic())):
                raise TimeoutError(f"no answer within {self.timeout} s")
            more = os.read(self.child.stdout.fileno(), 1 << 16)
            if not more:
                raise EOFError("the process ended")
            self.buffer += more
        line, self.buffer = self.buffer.split(b"\n", 1)
        return line

    def ask(self, method: str, params: dict) -> dict:
        self.sent += 1
        message = {"jsonrpc": "2.0", "id": self.sent, "method": method, "params": params}
        self.child.stdin.write(json.dumps(message, ensure_ascii=False).encode() + b"\n")
        self.child.stdin.flush()
        until = time.monotonic() + self.timeout
        while True:
            line = self._line(until).strip()
            answer = json.loads(line) if line else None
            if isinstance(answer, dict) and answer.get("id") == self.sent:
                return answer

    def close(self) -> None:
        self.ready.close()
        self.child.kill()
        self.child.wait()
        self.child.stdin.close()
        self.child.stdout.close()


def _payload(answer: dict) -> tuple[str | None, str | None]:
    """(result, error) as JSON: the first content's text decoded, {"raw": text} where it is no JSON, the whole result where it isn't text."""
    if "result" not in answer:
        return None, json.dumps(answer, ensure_ascii=False)
    result = answer["result"]
    content = result.get("content") if isinstance(result, dict) else None
    if content and content[0].get("type") == "text":
        text = content[0]["text"]
        try:
            result = json.loads(text)
        except ValueError:
            result = {"raw": text}
    return json.dumps(result, ensure_ascii=False), None


def call_tool(requests: DataFrame, command: list[str], tool: str, timeout: float = 120) -> DataFrame:
    """Rows of ``requests`` (arguments: a JSON object, and any other columns) with result and error, JSON strings of which one is null.

    A partition runs one child process, so the number of partitions bounds the calls at a time. A call that fails or
    exceeds ``timeout`` seconds gives an error row, and the next call starts a new process; arguments that are null or no
    object are an error without a call. Columns named result or error are replaced. A task that Spark repeats calls
    again: store the rows and take what is missing with :func:`missing_requests`.
    """
    rows = requests.drop("result", "error")

    def run(batches):
        process = None
        try:
            for batch in batches:
                results, errors = [], []
                for text in batch.column(batch.schema.get_field_index("arguments")).to_pylist():
                    result = error = None
                    try:
                        arguments = json.loads(text) if text is not None else None
                        if not isinstance(arguments, dict):
                            raise ValueError("arguments are no JSON object")
                        process = process or ToolProcess(command, timeout)
                        result, error = _payload(process.ask("tools/call", {"name": tool, "arguments": arguments}))
                    except (OSError, EOFError, ValueError) as e:
                        error = json.dumps(f"{type(e).__name__}: {e}", ensure_ascii=False)
                        if process is not None:
                            process.close()
                            process = None
                    results.append(result)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "result", "error"])
        finally:
            if process is not None:
                process.close()

    none = F.lit(None).cast("string")
    return rows.mapInArrow(run, rows.withColumns({"result": none, "error": none}).schema)


def by_source(source: Column) -> Column:
    """Arguments of TRANSCRIPT and METADATA."""
    return F.to_json(F.struct(source.alias("bvid_or_url")))


def search_pages(queries: DataFrame, pages: int = 1) -> DataFrame:
    """``queries`` (query, …) with page from 1 to ``pages`` and the arguments of VIDEOS."""
    rows = queries.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    return rows.withColumn("arguments", F.to_json(F.struct("query", "page")))


def missing_requests(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests whose arguments have no stored row with a result."""
    return requests.join(stored.where("result is not null").select("arguments"), "arguments", "left_anti")
