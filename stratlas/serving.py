"""What a server answers: search, a project's page, its neighbourhood. Small answers are kept for a while."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.operators import relational as R
from stratlas.operators import search as L
from stratlas.operators import vectors as V

#: How long a client may keep an answer, by what it is.
KEEP = {"tile": "public, max-age=31536000, immutable", "page": "public, max-age=300", "search": "public, max-age=60", "health": "no-store"}
KINDS = {"dependency": (0, 2), "all": (0, 1, 2)}


class Locks:
    """Locks by key in this process, each with an end."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.ends, self.guard = clock, {}, threading.Lock()

    def add(self, key, seconds: float) -> bool:
        with self.guard:
            now = self.clock()
            if self.ends.get(key, now) > now:
                return False
            self.ends[key] = now + seconds
            return True

    def release(self, key) -> None:
        with self.guard:
            self.ends.pop(key, None)


class Kept:
    """At most ``most`` answers, none older than ``seconds``."""

    def __init__(self, seconds: float, most: int = 1000, clock=time.monotonic):
        self.seconds, self.most, self.clock, self.rows = seconds, most, clock, OrderedDict()

    def peek(self, key, default=None):
        """The value kept for a key, else the default."""
        held = self.rows.get(key)
        return held[1] if held and self.clock() - held[0] < self.seconds else default

    def get(self, key, make):
        now = self.clock()
        if key in self.rows and now - self.rows[key][0] < self.seconds:
            self.rows.move_to_end(key)
            return self.rows[key][1]
        value = make()
        self.rows[key] = (now, value)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)
        return value


class SingleFlight:
    """One maker for each key at a time: the first caller makes the value, the others wait for it and take it.

    ``locks`` is any store with ``add(key, seconds)``, true for the first until it is released or its time is up, so that a
    caller that died doesn't block a key for ever, and ``release(key)``.
    """

    def __init__(self, kept: Kept, locks: Locks | None = None, seconds: float = 60.0, pause: float = 0.05, sleep=time.sleep):
        self.kept, self.locks, self.seconds, self.pause, self.sleep = kept, locks or Locks(), seconds, pause, sleep

    def get(self, key, make):
        missing = object()
        while True:
            value = self.kept.peek(key, missing)
            if value is not missing:
                return value
            if self.locks.add(key, self.seconds):
                try:
                    return self.kept.get(key, make)
                finally:
                    self.locks.release(key)
            self.sleep(self.pause)


class Server:
    """Answers over the catalogue's tables; ``vectors`` (id, v) and an ``embed`` function for queries are optional."""

    def __init__(self, repo: DataFrame, edge: DataFrame, ease: DataFrame | None = None, vectors: DataFrame | None = None, embed=None, now: str = "2026-01-01 00:00:00"):
        self.repo, self.edge, self.ease, self.vectors, self.embed, self.now = repo, edge, ease, vectors, embed, now
        self.answers = Kept(3600)

    def search(self, query: str, limit: int = 50, approachable: bool = False) -> tuple[list[dict], str]:
        """Rows and the arms that ran, such as ``dense+name+text``; 1…100 rows of a query of two characters or more."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must be 1 to 100")
        return self.answers.get((query.strip().lower(), limit, approachable), lambda: self._search(query, limit, approachable))

    def _search(self, query: str, limit: int, approachable: bool) -> tuple[list[dict], str]:
        dense = None
        if self.vectors is not None and self.embed is not None:
            dense = V.search(self.vectors, "id", "v", list(self.embed(query)), 100)
        allowed = R.approachable(self.repo, self.ease, self.now) if approachable and self.ease is not None else None
        top = L.hybrid(self.repo, query, dense, limit, allowed)
        rows = top.join(self.repo.select("id", "full_name", "description", "stars"), "id").orderBy(F.desc("score"), "id").collect()
        return [r.asDict() for r in rows], "dense+name+text" if dense is not None else "name+text"

    def page(self, id_: int | None = None, name: str | None = None) -> dict | None:
        """A project's page by name, which never falls back to the id, or by id; None if there is none."""
        if name is not None:
            hit = F.lower("full_name") == name.lower()
        elif id_ is not None:
            hit = F.col("id") == id_
        else:
            raise ValueError("id or name")
        rows = R.detail(self.repo.where(hit)).orderBy("id").limit(1).collect()
        return rows[0].asDict() if rows else None

    def graph(self, id_: int, kind: str = "all", depth: int = 1, limit: int = 500) -> dict:
        """Nodes and edges around a project, the heaviest first; a project without edges is its own only node."""
        if kind not in KINDS or not 1 <= depth <= 3:
            raise ValueError("kind or depth")
        ids = self.repo.where(F.col("id") == id_).select("id")
        rows = R.neighbourhood(self.edge, self.repo, ids, KINDS[kind], depth, limit).collect()
        nodes = {id_} | {r[e] for r in rows for e in ("src", "dst")}
        return {"nodes": sorted(nodes), "edges": [{k: r[k] for k in ("src", "dst", "kind", "weight")} for r in rows]}
