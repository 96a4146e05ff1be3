"""Retrieval by a child process: one for each task, spoken to in lines of JSON over its standard input and output.

Requests have ``cmd``: ``hello`` (answered by arm, corpus_id and n_docs), ``names``, ``query`` (text, k; answered by hits of doc_id and score, best
first), ``stats`` and ``shutdown``. A child that serves another arm or another corpus than is asked for is refused before any query.
One that dies or doesn't answer in time is started again, and the request is repeated: queries change nothing.
"""

from __future__ import annotations

import json
import os
import selectors
import subprocess
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import GuardError


class ChildError(RuntimeError):
    """What a child has answered, or that it has stopped answering."""


class Lines:
    """Lines to and from a process, with a time limit for each answer."""

    def __init__(self, argv: list[str]):
        # Its errors go where the task's do: a pipe that nobody reads would fill up and block it.
        self.process = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        os.set_blocking(self.process.stdout.fileno(), False)
        self.held = b""

    def send(self, line: str) -> None:
        try:
            self.process.stdin.write(line.encode() + b"\n")
            self.process.stdin.flush()
        except (BrokenPipeError, ValueError) as e:
            raise ChildError(f"the child has ended with code {self.process.poll()}") from e

    def receive(self, seconds: float) -> str:
        until = time.monotonic() + seconds
        with selectors.DefaultSelector() as ready:
            ready.register(self.process.stdout, selectors.EVENT_READ)
            while b"\n" not in self.held:
                left = until - time.monotonic()
                if left <= 0 or not ready.select(left):
                    raise ChildError(f"no answer in {seconds} s")
                part = os.read(self.process.stdout.fileno(), 1 << 16)
                if not part:
                    raise ChildError(f"the child has ended with code {self.process.wait()}")
                self.held += part
        line, _, self.held = self.held.partition(b"\n")
        return line.decode()

    def close(self) -> None:
        if self.process.poll() is None:
            try:
                self.send(json.dumps({"cmd": "shutdown"}))
                self.process.wait(timeout=5)
            except (ChildError, subprocess.TimeoutExpired):
                pass
        if self.process.poll() is None:
            self.process.kill()
            self.process.wait()
        self.process.stdin.close()
        self.process.stdout.close()


class Child:
    """A retriever in another process. ``start`` makes the lines to it anew; counts are those of this side."""

    def __init__(self, start: Callable[[], Lines], arm: str, corpus_id: str | None = None, seconds: float = 60.0, begin_seconds: float = 600.0, restarts: int = 2):
        self.start, self.arm, self.corpus_id, self.seconds, self.begin_seconds, self.left = start, arm, corpus_id, seconds, begin_seconds, restarts
        self.n_queries = self.n_returned = self.n_restarts = 0
        self.lines: Lines | None = None
        self.info: dict = {}
        self._begin()

    def _begin(self) -> None:
        self.lines = self.start()
        try:
            self.info = self._answer({"cmd": "hello"}, self.begin_seconds)
            for what, want in (("arm", self.arm), ("corpus_id", self.corpus_id)):
                if want is not None and self.info.get(what) != want:
                    raise GuardError(f"the child serves {what} {self.info.get(what)!r}, asked for is {want!r}")
        except Exception:
            self.lines.close()
            raise

    def _answer(self, request: dict, seconds: float) -> dict:
        self.lines.send(json.dumps(request))
        raw = self.lines.receive(seconds)
        try:
            got = json.loads(raw)
        except json.JSONDecodeError as e:
            raise ChildError(f"not JSON: {raw[:200]!r}") from e
        if "error" in got:
            raise ValueError(f"the child refuses: {got['error']}")
        return got

    def request(self, request: dict) -> dict:
        """One answer. A child that fails to give it is started again, as often as is left; what it refuses isn't asked again."""
        while True:
            try:
                return self._answer(request, self.seconds)
            except ChildError:
                self.lines.close()
                if not self.left:
                    raise
                self.left, self.n_restarts = self.left - 1, self.n_restarts + 1
                self._begin()

    def names(self) -> list[str]:
        return self.request({"cmd": "names"})["names"]

    def query(self, text: str, k: int) -> list[tuple[int, float]]:
        hits = self.request({"cmd": "query", "text": text, "k": k})["hits"]
        self.n_queries, self.n_returned = self.n_queries + 1, self.n_returned + len(hits)
        return [(h["doc_id"], h["score"]) for h in hits]

    def close(self) -> None:
        self.lines.close()


def serve(answer: Callable[[str, int], list[tuple[int, float]]], arm: str, corpus_id: str, names: list[str]) -> None:
    """The child's side: answers lines from standard input until ``shutdown`` or their end. What goes wrong with one request is its answer."""
    n = 0
    for line in sys.stdin:
        try:
            request = json.loads(line)
            cmd = request.get("cmd")
            if cmd == "shutdown":
                return
            if cmd == "query":
                n += 1
                out: dict = {"hits": [{"doc_id": i, "score": s} for i, s in answer(request["text"], request["k"])]}
            else:
                out = {"hello": {"arm": arm, "corpus_id": corpus_id, "n_docs": len(names)}, "names": {"names": names}, "stats": {"n_queries": n}}.get(cmd) or {"error": f"unknown request {cmd!r}"}
        except Exception as e:  # noqa: BLE001 - the other side is told
            out = {"error": f"{type(e).__name__}: {e}"}
        print(json.dumps(out), flush=True)


@dataclass
class ChildRetriever:
    """The retrievers' protocol over children: each task starts one by ``argv`` and asks it its queries. Null texts aren't asked."""

    argv: list[str]
    name: str
    corpus_id: str | None = None
    seconds: float = 60.0

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        argv, arm, corpus_id, seconds = list(self.argv), self.name, self.corpus_id, self.seconds

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            child = None
            try:
                for rows in batches:
                    out = []
                    for qid, text in zip(rows["qid"], rows["text"], strict=True):
                        child = child or Child(lambda: Lines(argv), arm, corpus_id, seconds)
                        out += [(qid, i, s, r) for r, (i, s) in enumerate(child.query(text, k), 1)]
                    yield pd.DataFrame(out, columns=["qid", "doc_id", "score", "rank"])
            finally:
                if child:
                    child.close()

        asked = queries.select(F.col("qid").cast("long").alias("qid"), "text").where("text is not null")
        return asked.mapInPandas(run, "qid long, doc_id long, score double, rank int")
