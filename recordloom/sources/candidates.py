"""Candidate relations from registries and catalogues, and a polite client for live use.

A source answers (candidates, error): no error with no candidates is a genuine negative, an error means that it
wasn't checked. Offline, both are tables; live, `live_candidates` calls an injected function for each record. A
source's records are several tasks' work: each has slots of the clock of its own, and pauses are shared by files.
"""

from __future__ import annotations

import email.utils
import ipaddress
import random
import socket
import threading
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.sources import catalogues

#: Seconds between requests to a source.
SPACING = {"crossref": 0.25, "datacite": 0.35, "openalex": 0.35, "gesis": 0.75, "arxiv": 3.0, "pubmed": 0.4, "semantic_scholar": 3.1, "core": 1.5, "openaire": 0.75, "dnb": 0.75, "hal": 0.75, "cinii": 0.75, "unpaywall": 0.2, "doaj": 0.5, "europepmc": 0.35, "google_books": 1.0, "lens": 1.0, "swisscovery": 0.75, "libris": 0.75}
ATTEMPTS, LONGEST_WAIT = 4, 120.0
CANDIDATE = "record string, source string, cand_pos int, title string, doi string, url string, url_is_reference_only boolean, authors array<string>, year int, abstract string"


class Limiter:
    """A least interval between calls, and a shared pause after an answer that asks for one."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self._next, self._lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self._lock:
            now = self.clock()
            pause = max(0.0, self._next - now)
            self._next = max(now, self._next) + self.interval
        if pause:
            self.sleep(pause)

    def defer(self, seconds: float) -> None:
        with self._lock:
            self._next = max(self._next, self.clock() + seconds)


class Pauses:
    """Until when a source asked to be left alone, known to all tasks by names of empty files in a shared folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self):
        from pyarrow import fs

        if "://" in self.folder:
            return fs.FileSystem.from_uri(self.folder)
        return fs.LocalFileSystem(), self.folder.removeprefix("file:")

    def put(self, source: str, until: float) -> None:
        files, path = self._open()
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{source}@{int(until * 1000) + 1}"):
            pass

    def get(self, source: str) -> float:
        from pyarrow import fs

        files, path = self._open()
        names = [x.base_name for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True))]
        return max((int(name.rpartition("@")[2]) / 1000 for name in names if name.rpartition("@")[0] == source), default=0.0)


class SlotLimiter:
    """The calls of one of `shares` tasks that ask a source together, at most one in each `interval` of all of them.

    Time is cut into slots of `interval` seconds, and slot n belongs to task n mod `shares`. A call waits for the begin
    of the task's next slot, never for the one that runs: a task that is started again doesn't use its predecessor's
    slot twice. The tasks' clocks have to agree to a part of the interval, and one attempt of a task may run at a time
    (no speculation). Pauses go to `pauses`, so that all tasks keep them, those started again too.
    """

    def __init__(self, source: str, interval: float, share: int, shares: int, pauses: Pauses | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.source, self.interval, self.share, self.shares, self.pauses, self.clock, self.sleep = source, interval, share, shares, pauses, clock, sleep
        self._last, self._until = -1, 0.0

    def _free_from(self) -> float:
        return max(self._until, self.pauses.get(self.source) if self.pauses else 0.0)

    def wait(self) -> None:
        while True:
            slot = max(int(max(self.clock(), self._free_from()) / self.interval), self._last) + 1
            slot += (self.share - slot) % self.shares
            if (pause := slot * self.interval - self.clock()) > 0:
                self.sleep(pause)
            if self._free_from() <= slot * self.interval:  # nobody was told to pause meanwhile
                self._last = slot
                return

    def defer(self, seconds: float) -> None:
        self._until = max(self._until, self.clock() + seconds)
        if self.pauses:
            self.pauses.put(self.source, self._until)


def retry_after(header: str | None, attempt: int, now: float | None = None) -> float:
    """Seconds that an answer asks to wait, from 1 to LONGEST_WAIT; without a header a growing pause."""
    if header:
        try:
            seconds = float(header)
        except ValueError:
            try:
                seconds = email.utils.parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now)
            except (TypeError, ValueError):
                seconds = 1.0
        return min(LONGEST_WAIT, max(1.0, seconds))
    return min(60.0, 3.0 * 2**attempt + random.random())


#: Statuses that another attempt may mend, and the header of a budget that is used up.
TRANSIENT = {429, 500, 502, 503, 504}


def with_retry(call: Callable[[], tuple], limiter: Limiter, attempts: int = ATTEMPTS, tell: Callable[[dict], None] = lambda event: None) -> tuple[bytes | None, str | None]:
    """(body, error) of a call that answers (status, Retry-After, body) and, if it can tell, the rest of its budget.

    TRANSIENT statuses and lost connections are tried again after a pause; a 429 with a budget of 0 fails at once, as
    no pause within reach would help. `tell` hears of each failed attempt.
    """
    error = None
    for attempt in range(attempts):
        limiter.wait()
        try:
            status, header, body, *budget = call()
        except OSError as lost:
            error, pause = f"{type(lost).__name__}: {lost}", min(30.0, 2.0 * 2**attempt + random.random())
        else:
            if status < 400:
                return body, None
            error = f"HTTP {status}"
            if status not in TRANSIENT:
                return None, error
            if status == 429 and budget and str(budget[0]).strip() == "0":
                tell({"attempt": attempt, "error": error, "pause": None})
                return None, f"{error}: the budget is used up"
            pause = retry_after(header, attempt) if status == 429 else min(30.0, 2.0 * 2**attempt + random.random())
        tell({"attempt": attempt, "error": error, "pause": pause if attempt + 1 < attempts else None})
        if attempt + 1 < attempts:
            limiter.defer(pause)
    return None, error


#: Most bytes of a page, a container's page and a PDF, and redirects that are followed.
PAGE_BYTES, CONTAINER_BYTES, PDF_BYTES, REDIRECTS = 512 << 10, 2 << 20, 15 << 20, 5


def safe_get(url: str, get: Callable[[str], tuple[int, dict, Iterator[bytes]]], limit: int = PAGE_BYTES, redirects: int = REDIRECTS, resolve: Callable[[str], list[str]] | None = None) -> tuple[int, str, bytes]:
    """(status, final address, body) of `get` (status, headers, chunks), which follows no redirects itself.

    Each hop's host must have public addresses only, and no more than `limit` bytes are read; ValueError otherwise.
    """
    for _ in range(redirects + 1):
        if not is_public(url, resolve):
            raise ValueError("the address isn't public")
        status, headers, chunks = get(url)
        target = {k.casefold(): v for k, v in headers.items()}.get("location")
        if not (300 <= status < 400 and target):
            body = bytearray()
            for chunk in chunks:
                body += chunk
                if len(body) > limit:
                    raise ValueError(f"more than {limit} bytes")
            return status, url, bytes(body)
        url = urljoin(url, target)
    raise ValueError("too many redirects")


def is_public(url: str, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """Whether a URL is http(s) and its host has public addresses only."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return False
    try:
        found = (resolve or (lambda host: [x[4][0] for x in socket.getaddrinfo(host, None)]))(parts.hostname)
        return bool(found) and all(ipaddress.ip_address(x).is_global for x in found)
    except (OSError, ValueError):
        return False


# payloads


def _rows(record: str, source: str, payload: str | None) -> Iterator[tuple]:
    for i, x in enumerate(catalogues.candidates(source, payload) if payload else ()):
        yield record, source, i, x["title"], x["doi"], x["url"], x["url_is_reference_only"], x["authors"], x["year"], x["abstract"]


_COLUMNS = ["record", "source", "cand_pos", "title", "doi", "url", "url_is_reference_only", "authors", "year", "abstract"]


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Candidates from stored answers (record, source, payload as JSON text); sources without a parser are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for r, s, p in zip(batch["record"], batch["source"], batch["payload"], strict=True) for row in _rows(r, s, p)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"year": "Int32"})

    return payloads.select(F.col("record").cast("string").alias("record"), "source", "payload").mapInPandas(run, CANDIDATE)


def live_candidates(asked: DataFrame, fetch: Callable[[str, str, str], tuple[int, str | None, bytes]], shares: int = 4, pauses: Pauses | None = None, spacing: dict[str, float] | None = None) -> DataFrame:
    """record, source, payload and error for each row of `asked` (record, source, title) by an injected `fetch`.

    A source's records are dealt to `shares` tasks by hash. They keep the source's spacing together, by slots of the
    clock, so that a slow answer holds up one share only. `pauses` has to be in a folder that all executors see; without
    it a pause is known to the task that was told. Null records and titles are asked for like others.
    """
    spacing = SPACING | (spacing or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiters: dict[tuple[str, int], SlotLimiter] = {}
        for batch in batches:
            out = []
            for record, source, title, share in zip(batch["record"], batch["source"], batch["title"], batch["share"], strict=True):
                limiter = limiters.setdefault((source, share), SlotLimiter(source, spacing.get(source, 1.0), share, shares, pauses))
                body, error = with_retry(lambda s=source, t=title, r=record: fetch(s, t, r), limiter)
                out.append((record, source, None if body is None else body.decode("utf-8", "replace"), error))
            yield pd.DataFrame(out, columns=["record", "source", "payload", "error"])

    rows = asked.select(F.col("record").cast("string").alias("record"), "source", "title")
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("record", "title"), F.lit(shares)).cast("int"))
    # a fixed number of partitions: adaptive execution would put these short rows into one task
    return dealt.repartition(len(SPACING) * shares, "source", "share").mapInPandas(run, "record string, source string, payload string, error string")
