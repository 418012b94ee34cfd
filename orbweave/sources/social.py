"""A batch data source over a paginated follow-graph service: followers, follows, profiles, relationships and author feeds.

Network access is an injected transport: any callable (endpoint, parameters) -> (status, body). Options: endpoint, actors (comma separated, or JSON), transport
("module:function"), cap, partitions. Each partition reads its own actors; retries happen inside the reader, never by repeating a task's calls.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, dict]]

# Page sizes, caps, batch sizes and retry waits of the service's endpoints.
PAGE, PROFILES_PER_CALL, RELATIONSHIPS_PER_CALL = 100, 25, 30
FOLLOWERS_CAP, FOLLOWS_PAGES, POSTS_CAP = 3000, 5, 3000
WAITS = (1, 2, 4, 8, 16)

SCHEMAS = {
    "followers": "src string, dst string, status string",
    "follows": "src string, dst string, status string",
    "profiles": "handle string, did string, followers_count long, status string",
    "relationships": "src string, dst string, status string",
    "feed": "post_id string, user string, created_at string, text string, status string",
}


class Client:
    """Pages and batches over a transport. A failed call ends an actor's listing with what was read and a status other than ok."""

    def __init__(self, transport: Transport, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.sleep = transport, sleep

    def call(self, endpoint: str, params: dict) -> tuple[str, dict]:
        """ok, or the reason of the failure; a limited call is tried again after growing waits."""
        for wait in (*WAITS, None):
            try:
                status, body = self.transport(endpoint, params)
            except Exception as error:  # noqa: BLE001  any failure of the transport is a status
                return f"error: {type(error).__name__}", {}
            if status == 200:
                return "ok", body
            if status != 429 or wait is None:
                return f"http {status}", {}
            self.sleep(wait)
        raise AssertionError

    def pages(self, endpoint: str, params: dict, key: str) -> Iterator[tuple[str, list]]:
        cursor = None
        while True:
            status, body = self.call(endpoint, params | {"limit": PAGE} | ({"cursor": cursor} if cursor else {}))
            items = body.get(key) or []
            yield status, items
            cursor = body.get("cursor")
            if status != "ok" or not items or not cursor:
                return

    def _listed(self, endpoint: str, actor: str, key: str, cap: int) -> Iterator[tuple[str | None, str]]:
        n = 0
        for status, items in self.pages(endpoint, {"actor": actor}, key):
            for item in items:
                if n == cap:
                    return
                if item.get("handle"):
                    n += 1
                    yield item["handle"], "ok"
            if status != "ok":
                yield None, status
            if n >= cap:
                return

    def followers(self, actor: str, cap: int = FOLLOWERS_CAP) -> Iterator[tuple]:
        for handle, status in self._listed("getFollowers", actor, "followers", cap):
            yield handle, actor, status

    def follows(self, actor: str, cap: int = FOLLOWS_PAGES * PAGE) -> Iterator[tuple]:
        """Waiting for a limited call doesn't use up a page."""
        for handle, status in self._listed("getFollows", actor, "follows", cap):
            yield actor, handle, status

    def profiles(self, actors: list[str]) -> Iterator[tuple]:
        for lo in range(0, len(actors), PROFILES_PER_CALL):
            batch = actors[lo:lo + PROFILES_PER_CALL]
            status, body = self.call("getProfiles", {"actors": batch})
            for p in body.get("profiles") or []:
                yield p.get("handle"), p.get("did"), int(p.get("followersCount") or 0), "ok"
            if status != "ok":
                yield from ((a, None, None, status) for a in batch)

    def relationships(self, actor: str, others: dict[str, str]) -> Iterator[tuple]:
        """others: did -> handle."""
        dids = list(others)
        for lo in range(0, len(dids), RELATIONSHIPS_PER_CALL):
            status, body = self.call("getRelationships", {"actor": actor, "others": dids[lo:lo + RELATIONSHIPS_PER_CALL]})
            for r in body.get("relationships") or []:
                if r.get("following") and r.get("did") in others:
                    yield actor, others[r["did"]], "ok"
            if status != "ok":
                yield actor, None, status

    def feed(self, actor: str, cap: int = POSTS_CAP) -> Iterator[tuple]:
        """Posts with a text and a time; only these count towards the cap."""
        n = 0
        for status, items in self.pages("getAuthorFeed", {"actor": actor, "filter": "posts_no_replies"}, "feed"):
            for item in items:
                post = item.get("post") or {}
                record = post.get("record") or {}
                if record.get("text") and record.get("createdAt"):
                    if n == cap:
                        return
                    n += 1
                    yield post.get("uri") or f"{actor}/{n}", actor, record["createdAt"], record["text"], "ok"
            if status != "ok":
                yield None, actor, None, None, status
            if n >= cap:
                return


class _Actors(InputPartition):
    def __init__(self, actors: list):
        super().__init__(len(actors))
        self.actors = actors


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        raw = self.options.get("actors", "")
        actors = json.loads(raw) if raw.lstrip().startswith("[") else [a.strip() for a in raw.split(",") if a.strip()]
        n = max(1, min(int(self.options.get("partitions", "8")), len(actors)))
        if self.options["endpoint"] == "profiles":  # whole batches stay together
            actors = [actors[i:i + PROFILES_PER_CALL] for i in range(0, len(actors), PROFILES_PER_CALL)]
            return [_Actors([a for batch in actors[i::n] for a in batch]) for i in range(n)]
        return [_Actors(actors[i::n]) for i in range(n)]

    def read(self, partition):
        module, _, name = self.options["transport"].partition(":")
        client, endpoint = Client(getattr(importlib.import_module(module), name)), self.options["endpoint"]
        if endpoint == "profiles":
            yield from client.profiles(partition.actors)
            return
        more = {"cap": int(self.options["cap"])} if "cap" in self.options else {}
        if endpoint == "relationships":
            more = {"others": json.loads(self.options["others"])}
        for actor in partition.actors:
            yield from getattr(client, endpoint)(actor, **more)


class SocialSource(DataSource):
    """spark.dataSource.register(SocialSource); spark.read.format("social").option("endpoint", "followers")..."""

    @classmethod
    def name(cls) -> str:
        return "social"

    def schema(self) -> str:
        return SCHEMAS[self.options["endpoint"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def calibrate(probe: Callable[[int], bool], most: int = 100, step: int = 10) -> int:
    """Safe number of calls in flight: probe(n) tells whether n at once went without a refusal or an error.

    Tries n = step, 2 * step, ...; after the first refusal 70 % of that, at least step; else the last n.
    """
    n = step
    while n <= most:
        if not probe(n):
            return max(step, int(0.7 * n))
        n += step
    return n - step
