"""Exchange with services by recorded pages: a listing in pages, messages by topic as a stream, and files that arrive whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

LISTING = "path string, name string, size long, page int"
MESSAGES = "topic string, id long, ts string, sender string, text string, media string, action string"
FILES = "path string, size long, content binary"


def _local(path: str) -> str:
    return path.removeprefix("file:").replace("//", "/")


def _page(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@dataclass
class Page(InputPartition):
    path: str
    number: int


class _Listing(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        """One page each. Pages are those that a client asked for one after the other: page-0.json, page-1.json and so on."""
        numbers = sorted(int(x[5:-5]) for x in os.listdir(self.path) if x.startswith("page-") and x.endswith(".json"))
        if numbers != list(range(len(numbers))):
            raise ValueError(f"{self.path}: a page is missing")
        return [Page(os.path.join(self.path, f"page-{n}.json"), n) for n in numbers]

    def read(self, page: Page) -> Iterator[tuple]:
        for item in _page(page.path)["items"]:
            if item.get("type") != "dir":
                yield item["path"], item["path"].rsplit("/", 1)[-1], item.get("size"), page.number


class PagedListing(DataSource):
    """Files of a remote folder from recorded pages {"total": n, "items": [{"path", "size", "type"}]}; folders are left out."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Listing(_local(self.options["path"]))


@dataclass
class Span(InputPartition):
    """Messages of a topic beyond `after` and up to `upto`, and the pages that hold some of them."""

    topic: str
    after: int
    upto: int
    pages: list[str] = field(default_factory=list)


class _Messages(DataSourceStreamReader):
    """An offset is {topic: last id}. Pages are <topic>/<first id>-<last id>.json, each a list of messages in order of id."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.at = path, most, None

    def _pages(self) -> dict[str, list[tuple[int, int, str]]]:
        out = {}
        for topic in sorted(os.listdir(self.path)):
            folder = os.path.join(self.path, topic)
            if os.path.isdir(folder):
                named = (x[:-5].split("-") + [os.path.join(folder, x)] for x in os.listdir(folder) if x.endswith(".json"))
                out[topic] = sorted((int(a), int(b), p) for a, b, p in named)
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """As far as the pages go, but in each topic at most `most` pages beyond the last offset of this run."""
        known = self.at or {}
        out = dict(known)
        for topic, pages in self._pages().items():
            new = [b for _, b, _ in pages if b > known.get(topic, 0)]
            if new:
                out[topic] = new[: self.most][-1]
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = dict(end)
        pages = self._pages()
        spans = [Span(t, start.get(t, 0), last, [p for a, b, p in pages.get(t, []) if b > start.get(t, 0) and a <= last]) for t, last in sorted(end.items()) if last > start.get(t, 0)]
        return spans or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        names = MESSAGES.replace(",", "").split()[2::2]
        for path in span.pages:
            for m in _page(path):
                if span.after < m["id"] <= span.upto:
                    yield (span.topic, *(m.get(c) for c in names))

    def commit(self, end: dict) -> None:
        """Pages stay, so that a lost run can ask for them again."""


class TopicMessages(DataSource):
    """Messages by topic from recorded pages, as a stream with an offset for each topic; option pages: how many of a topic a batch takes at most."""

    @classmethod
    def name(cls) -> str:
        return "topic_messages"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Messages(_local(self.options["path"]), int(self.options.get("pages", "1000000")))


@dataclass
class Arrived(WriterCommitMessage):
    """What one task brought: (path, size, status, partial file)."""

    rows: list[tuple[str, int, str, str]]


class _Delivery(DataSourceWriter):
    """Files come under partial names; when all tasks are done, whole ones are renamed and the ledger gets its rows."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, rows: Iterator[Row]) -> Arrived:
        out = []
        for r in rows:
            target = os.path.realpath(os.path.join(self.root, r["path"]))
            if not target.startswith(os.path.realpath(self.root) + os.sep):
                raise ValueError(f"{r['path']}: outside the target")
            if os.path.isfile(target) and os.path.getsize(target) == r["size"]:
                out.append((r["path"], r["size"], "there", ""))
                continue
            if r["content"] is None:
                out.append((r["path"], r["size"], "absent", ""))
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{self.run}-{uuid.uuid4().hex}.part"
            with open(partial, "wb") as f:
                f.write(r["content"])
            whole = os.path.getsize(partial) == r["size"]
            out.append((r["path"], r["size"], "done" if whole else "wrong size", partial))
        return Arrived(out)

    def commit(self, messages: list[Arrived | None]) -> None:
        rows = [row for m in messages if m is not None for row in m.rows]
        for path, _, status, partial in rows:
            if status == "done":
                os.replace(partial, os.path.join(self.root, path))
            elif partial:
                os.remove(partial)
        os.makedirs(os.path.join(self.root, "_ledger"), exist_ok=True)
        ledger = os.path.join(self.root, "_ledger", f"{self.run}.tsv")
        with open(ledger + ".part", "w", encoding="utf-8") as f:
            f.writelines(f"{path}\t{size}\t{status}\n" for path, size, status, _ in rows)
        os.replace(ledger + ".part", ledger)
        self._sweep()

    def abort(self, messages: list[Arrived | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Partial files of this run go, also those of tasks that failed or ran twice."""
        for folder, _, names in os.walk(self.root):
            for x in names:
                if f".{self.run}-" in x and x.endswith(".part"):
                    os.remove(os.path.join(folder, x))


class Delivery(DataSource):
    """df.write.format("delivery").mode("append").save(target): files (path, size, content) below a folder that all executors see.

    A file that is there in its size is left alone; content null is an absent one; one of another size is not kept. The folder's
    _ledger tells path, size and status of each run, and only of runs that ended well.
    """

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are only added: use mode append")
        return _Delivery(_local(self.options["path"]), uuid.uuid4().hex[:12])
