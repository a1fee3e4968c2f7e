"""Driver-side orchestration: phase order, sagas, topic weights, caches, themes, timing."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame


class Phase(IntEnum):
    """The intelligence cycle in order."""

    PLANNING = 1
    COLLECTION = 2
    PROCESSING = 3
    ANALYSIS = 4
    DISSEMINATION = 5
    EVALUATION = 6


def topological_order(needs: dict[str, list[str]]) -> list[str]:
    """Tasks with what they need before them; a cycle is an error."""
    left = {k: set(v) for k, v in needs.items()}
    for v in needs.values():
        for x in v:
            left.setdefault(x, set())
    out: list[str] = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        out += ready
        left = {k: v - set(ready) for k, v in left.items() if v}
    return out


def run_dag(tasks: dict[str, Callable[[dict], object]], needs: dict[str, list[str]]) -> dict[str, object]:
    """Run tasks in order, each with the results so far; the first error ends the run."""
    done: dict[str, object] = {}
    for name in topological_order({t: needs.get(t, []) for t in tasks}):
        done[name] = tasks[name](done)
    return done


class Saga:
    """Steps with compensations: an error undoes what was done, last first, and is raised again."""

    def __init__(self) -> None:
        self._steps: list[tuple[str, Callable, Callable]] = []
        self.log: list[str] = []

    def step(self, name: str, do: Callable, undo: Callable = lambda _: None) -> Saga:
        self._steps.append((name, do, undo))
        return self

    def run(self, context):
        done = []
        try:
            for name, do, undo in self._steps:
                context = do(context)
                self.log.append(name)
                done.append((name, undo))
        except Exception:
            for name, undo in reversed(done):
                undo(context)
                self.log.append(f"undo {name}")
            raise
        return context


@dataclass
class Directive:
    directive_id: str
    topics: list[str]
    quotas: dict[str, int]


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Negatives as zero, then shares; all zero gives equal shares."""
    w = {k: max(0.0, v) for k, v in weights.items()}
    total = sum(w.values())
    return {k: v / total if total else 1 / len(w) for k, v in w.items()}


@dataclass
class TopicPlanner:
    """Topic weights moved by usage, knowledge gaps and drift: w' = norm(alpha w + beta usage + gamma gap + delta drift), our formula."""

    weights: dict[str, float] = field(default_factory=dict)
    alpha: float = 0.5
    beta: float = 0.2
    gamma: float = 0.2
    delta: float = 0.1

    def feedback(self, usage: dict[str, float], gaps: dict[str, float], drift: dict[str, float]) -> dict[str, float]:
        names = {*self.weights, *usage, *gaps, *drift}
        shares = [normalized({n: x.get(n, 0.0) for n in names}) if any(x.values()) else dict.fromkeys(names, 0.0) for x in (self.weights, usage, gaps, drift)]
        self.weights = normalized({n: sum(c * s[n] for c, s in zip((self.alpha, self.beta, self.gamma, self.delta), shares, strict=True)) for n in names})
        return self.weights

    def plan(self, context: dict, cycle: str) -> dict:
        """The planning phase: a directive goes into the context."""
        return {**context, "directive": self.directive(cycle)}

    def undo_plan(self, context: dict) -> dict:
        """Its compensation clears the directive again."""
        context.pop("directive", None)
        return context

    def directive(self, cycle: str, budget: int = 50, least: int = 5) -> Directive:
        return Directive(f"dir_{cycle}", sorted(self.weights), {t: max(least, round(w * budget)) for t, w in self.weights.items()})


def harvest(sources: dict[str, Callable[[str, int], DataFrame]], topics: list[str], quota: int = 10) -> tuple[list[DataFrame], list[dict]]:
    """(frames, errors): a source that fails gives an error record, not an exception."""
    frames, errors = [], []
    for topic in topics:
        for name, read in sources.items():
            try:
                frames.append(read(topic, quota))
            except Exception as e:  # a failed source is data here
                errors.append({"topic": topic, "source": name, "error": str(e)})
    return frames, errors


class LruCache:
    """A bounded cache with hit counts."""

    def __init__(self, size: int = 512):
        self.size, self.hits, self.misses, self._items = size, 0, 0, OrderedDict()

    def get(self, key):
        if key in self._items:
            self.hits += 1
            self._items.move_to_end(key)
            return self._items[key]
        self.misses += 1
        return None

    def put(self, key, value) -> None:
        self._items[key] = value
        self._items.move_to_end(key)
        while len(self._items) > self.size:
            self._items.popitem(last=False)

    @property
    def hit_ratio(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class SemanticCache:
    """Answers by query: equal when trimmed and lower-cased, else of a word-set similarity of 0.95; entries live an hour."""

    def __init__(self, size: int = 100, ttl: float = 3600.0, least: float = 0.95, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.least, self.clock = size, ttl, least, clock
        self._items: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, query: str):
        now, key = self.clock(), query.strip().lower()
        for k in [k for k, (t, _) in self._items.items() if now - t > self.ttl]:
            del self._items[k]
        if key in self._items:
            return self._items[key][1]
        words = set(key.split())
        for k, (_, value) in self._items.items():
            other = set(k.split())
            if words and other and len(words & other) / len(words | other) >= self.least:
                return value
        return None

    def put(self, query: str, value) -> None:
        key = query.strip().lower()
        self._items.pop(key, None)
        while len(self._items) >= self.size:  # the oldest goes
            self._items.popitem(last=False)
        self._items[key] = (self.clock(), value)


@dataclass(frozen=True)
class Theme:
    name: str
    sources: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    root: str = ""


class ThemeRegistry:
    """Built-in and added themes; each writes under a root of its own."""

    def __init__(self) -> None:
        self.themes = {n: Theme(n, root=f"outputs/{n}") for n in ("security", "ai_safety", "software_engineering")}

    def add(self, spec: dict) -> Theme:
        t = Theme(spec["name"], tuple(spec.get("sources", ())), tuple(spec.get("keywords", ())), spec.get("root") or f"outputs/{spec['name']}")
        self.themes[t.name] = t
        return t


def profile(run: Callable[[], object], iterations: int = 5, warm_up: int = 1) -> dict[str, float]:
    """Seconds for each run after the warm-up, and runs a second."""
    for _ in range(warm_up):
        run()
    began = time.perf_counter()
    for _ in range(iterations):
        run()
    took = time.perf_counter() - began
    return {"iterations": iterations, "seconds": took / iterations, "per_second": iterations / took if took else 0.0}


class Distributor:
    """Hands products (product_id, ...) to all channels; a channel that fails is noted and the others go on."""

    def __init__(self) -> None:
        self.channels: dict[str, Callable[[DataFrame], object]] = {}
        self.errors: list[dict] = []
        self._published: DataFrame | None = None

    def register(self, name: str, send: Callable[[DataFrame], object]) -> None:
        self.channels[name] = send

    def disseminate(self, products: DataFrame) -> None:
        self._published = products if self._published is None else self._published.unionByName(products, allowMissingColumns=True)
        for name, send in self.channels.items():
            try:
                send(products)
            except Exception as e:  # a failed channel is data here
                self.errors.append({"channel": name, "error": str(e)})

    def compensate(self, products: DataFrame) -> None:
        """Takes the batch's ids back from what was published."""
        if self._published is not None:
            self._published = self._published.join(products.select("product_id").distinct(), "product_id", "left_anti")

    def published(self) -> DataFrame | None:
        return self._published


def run_theme(theme: Theme, sources: dict[str, Callable[[str, int], DataFrame]], transform: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], object], quota: int = 10, topic: str | None = None) -> tuple[DataFrame | None, list[dict]]:
    """(items, errors) of a theme: each of its sources is asked, what they give is transformed, and a summary written under its root."""
    wanted = {n: read for n, read in sources.items() if not theme.sources or n in theme.sources}
    frames, errors = harvest(wanted, [topic or next(iter(theme.keywords), theme.name)], quota)
    if not frames:
        return None, errors
    items = frames[0]
    for df in frames[1:]:
        items = items.unionByName(df, allowMissingColumns=True)
    done = transform(items)
    write(done, theme.root)
    return done, errors
