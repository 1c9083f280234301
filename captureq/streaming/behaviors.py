"""Page behaviours as registered table functions.

A behaviour is a class with an id, is_match(html) and run(html, options) yielding messages and returning decisions. Only
classes of the registry run; request text is never executed. A behaviour that fails is reported, the others go on."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Autoscroll:
    id = "autoscroll"

    def is_match(self, html: str) -> bool:
        return True

    def run(self, html: str, options: dict):
        most = int(options.get("maxSteps", 40))
        height = html.count("<p") + html.count("<div")
        steps = min(most, height)
        for _ in range(steps):
            yield "scrolled"
        return {"scrollSteps": steps, "reachedBottom": height <= most}


class Autofetch:
    id = "autofetch"

    def is_match(self, html: str) -> bool:
        return "src" in html

    def run(self, html: str, options: dict):
        urls = list(dict.fromkeys(re.findall(r"""(?i)\ssrc\s*=\s*["']([^"']+)["']""", html)))[: int(options.get("most", 2000))]
        for _ in urls:
            yield "fetched"
        return {"candidates": len(urls)}


class Autoplay:
    id = "autoplay"

    def is_match(self, html: str) -> bool:
        return re.search(r"(?i)<(video|audio)\b", html) is not None

    def run(self, html: str, options: dict):
        n = len(re.findall(r"(?i)<(?:video|audio)\b", html))
        for _ in range(n):
            yield "played"
        return {"media": n}


#: Behaviours by id; a deployment adds its own classes here, requests name them.
REGISTRY: dict[str, type] = {c.id: c for c in (Autoscroll, Autofetch, Autoplay)}


def run_all(html: str, ids: list[str], options: dict[str, dict]) -> list[tuple[str, int, str | None, str | None]]:
    """(id, steps, error, decisions as JSON) of every registered and matching behaviour, in the given order."""
    out = []
    for i in dict.fromkeys(ids):
        cls = REGISTRY.get(i)
        if cls is None:
            continue
        steps, error, decisions = 0, None, None
        try:
            own = cls()
            try:
                if not own.is_match(html):
                    continue
            except Exception:  # noqa: BLE001  a failing test is no match
                continue
            run = own.run(html, options.get(i, {}))
            while True:
                try:
                    next(run)
                    steps += 1
                except StopIteration as end:
                    decisions = json.dumps(end.value, sort_keys=True)
                    break
        except Exception as e:  # noqa: BLE001  reported, the others go on
            error = f"{type(e).__name__}: {e}"
        out.append((i, steps, error, decisions))
    return out


@udtf(returnType="behavior string, steps int, error string, decisions string")
class RunBehaviors:
    def eval(self, html: str, ids: str, options: str):
        yield from run_all(html or "", [x.strip() for x in (ids or "").split(",") if x.strip()], json.loads(options or "{}"))


def register(spark: SparkSession) -> None:
    """Make run_behaviors(html, ids, options) known to SQL."""
    spark.udtf.register("run_behaviors", RunBehaviors)
