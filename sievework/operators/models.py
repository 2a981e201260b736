"""Model-backed operators: a registry of role functions with deterministic stubs, prompts, retries, structured output, tracing."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.batches import sliced

# Retry defaults.
ATTEMPTS, BASE_DELAY_S = 3, 0.5
RETRYABLE = ("TimeoutError", "ConnectionError", "RateLimitError", "APIConnectionError", "APITimeoutError", "InternalServerError", "ServiceUnavailableError")


@dataclass
class Prompt:
    id: str
    version: int
    role: str
    template: str
    system: str = ""
    few_shot: list[tuple[str, str]] = field(default_factory=list)

    @property
    def label(self) -> str:
        return f"{self.id}@v{self.version}"

    def render(self, **values: Any) -> list[dict[str, str]]:
        """Messages: system, examples in pairs, then the template filled, or the values as JSON without one."""
        out = [{"role": "system", "content": self.system}] if self.system else []
        for question, answer in self.few_shot:
            out += [{"role": "user", "content": question}, {"role": "assistant", "content": answer}]
        return out + [{"role": "user", "content": self.template.format(**values) if self.template else json.dumps(values, ensure_ascii=False, sort_keys=True)}]


class Prompts:
    """Versioned prompts; without a version the latest."""

    def __init__(self) -> None:
        self.held: dict[str, dict[int, Prompt]] = {}

    def add(self, prompt: Prompt) -> None:
        self.held.setdefault(prompt.id, {})[prompt.version] = prompt

    def get(self, name: str, version: int | None = None) -> Prompt:
        versions = self.held[name]
        return versions[max(versions) if version is None else version]


class Registry:
    """Named plug-ins (strategies, tools, model roles, captioners)."""

    def __init__(self, kind: str):
        self.kind, self.held = kind, {}

    def add(self, name: str, value: Callable) -> Callable:
        self.held[name] = value
        return value

    def get(self, name: str) -> Callable:
        if name not in self.held:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self.held))}")
        return self.held[name]

    def available(self) -> list[str]:
        return sorted(self.held)


roles = Registry("model role")


def retryable(error: Exception) -> bool:
    return any(c.__name__ in RETRYABLE for c in type(error).__mro__)


def resilient(call: Callable, fallbacks: list[Callable] = (), attempts: int = ATTEMPTS, delay: float = BASE_DELAY_S, sleep: Callable = time.sleep) -> Callable:
    """call with retries at growing delays, then the fallbacks in turn; an error that no retry mends goes to them at once."""

    def run(*args: Any) -> Any:
        for k in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                last = e
                if not retryable(e):
                    break
                if k + 1 < attempts:
                    sleep(delay * 2**k)
        for other in fallbacks:
            try:
                return other(*args)
            except Exception as e:
                last = e
        raise last

    return run


def structured(text: str, check: Callable[[Any], Any], repair: Callable[[str], str] | None = None) -> Any:
    """check(parsed JSON), fenced or not; on failure the repair's text gets one try."""
    for k in range(2):
        try:
            m = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
            return check(json.loads(m[1] if m else text))
        except (ValueError, TypeError, KeyError):
            if k or repair is None:
                raise
            text = repair(text)
    raise AssertionError


@dataclass
class Policy:
    """How a role is called: attempts and delay of retries, roles that stand in, calls at once, and after how many failures in a row
    a task stops calling (0: never)."""

    attempts: int = ATTEMPTS
    delay_s: float = BASE_DELAY_S
    fallbacks: tuple[str, ...] = ()
    at_once: int = 1
    stop_after: int = 0


policies: dict[str, Policy] = {}
#: Rows of a slice of an Arrow batch, which `sliced` bounds in bytes too: what a task holds as objects at once.
CALLS = 256


def map_model(rows: DataFrame, column: str, out: str, role: str, isolate: bool = True, policy: Policy | None = None) -> DataFrame:
    """rows with out (the role's result text) and out_error: one call a row in Arrow batches, failures stay in their row.

    The role's policy (policies, or the one given) retries, falls back, and keeps up to `at_once` calls going within a batch;
    results come in the rows' order. After `stop_after` failures in a row the task's further rows fail without a call.
    """
    how = policy or policies.get(role, Policy())
    call = resilient(roles.get(role), [roles.get(f) for f in how.fallbacks], max(1, how.attempts), how.delay_s)
    at = rows.columns.index(column)
    schema = T.StructType([*rows.schema, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def one(value: Any) -> tuple[str | None, str | None]:
        try:
            return call(value), None
        except Exception as e:
            if not isolate:
                raise
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        with ThreadPoolExecutor(max(1, how.at_once)) as pool:
            for b in sliced(batches, at, CALLS):
                values, made = b.column(at).to_pylist(), []
                for low in range(0, len(values), max(1, how.at_once)):
                    part = values[low : low + max(1, how.at_once)]
                    if how.stop_after and failed >= how.stop_after:
                        made += [(None, f"Stopped: {failed} failures in a row")] * len(part)
                        continue
                    got = [one(part[0])] if len(part) == 1 else list(pool.map(one, part))
                    made += got
                    for _, error in got:
                        failed = failed + 1 if error else 0
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m for m, _ in made], pa.string()), pa.array([e for _, e in made], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Embedding backends by name: list of texts -> list of (dense, sparse); `hashed` is the built-in one.
backends = Registry("embedding backend")


def backend(settings: dict) -> Callable | None:
    """The embedding backend that the settings (or, through ${VAR} in them, the environment) name."""
    name = settings.get("backends", {}).get("embedding", "hashed")
    return None if name == "hashed" else backends.get(name)


#: Characters of an answer that wait until the guard has seen what follows them: longer than any pattern's match may be.
HELD_BACK = 64


def stream_model(rows: DataFrame, column: str, role: str, guard: Callable[[str], str | None] | None = None, held_back: int = HELD_BACK, key: str = "query_id") -> DataFrame:
    """key, n, delta, reason: what a role that yields parts says, a row a part as it comes (a role that returns a text says it at once).

    guard(running text) names a reason to stop or None. The last `held_back` characters wait until more text has come, so a
    match that the guard finds only when it is whole hasn't been said in part. A stopped answer's last row has the reason and
    no text; other answers' deltas make up the whole answer.
    """
    call = roles.get(role)
    kind = rows.schema[key].dataType.simpleString()
    width = held_back if guard else 0

    def parts(value: Any) -> Iterator[tuple[str, str | None]]:
        said = call(value)
        text, sent = "", 0
        for part in [said] if isinstance(said, str) else said or ():
            text += part
            if guard and (reason := guard(text)):
                yield "", reason
                return
            if len(text) - width > sent:
                yield text[sent : len(text) - width], None
                sent = len(text) - width
        if sent < len(text):
            yield text[sent:], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n = 0
                try:
                    for delta, reason in parts(value):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), pa.array([n], pa.int64()), pa.array([delta]), pa.array([reason], pa.string())], names=[key, "n", "delta", "reason"])
                        n += 1
                except Exception as e:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), pa.array([n], pa.int64()), pa.array([""]), pa.array([f"{type(e).__name__}: {e}"])], names=[key, "n", "delta", "reason"])

    return rows.select(key, column).mapInArrow(run, f"{key} {kind}, n long, delta string, reason string")


# --- deterministic stubs ------------------------------------------------------------------------------------------------


def first_sentence(text: str | None) -> str:
    return re.split(r"(?<=[.!?])\s+", (text or "").strip())[0]


def intent_of(text: str | None) -> str:
    """A rule of thumb for a question's intent."""
    low = (text or "").lower().strip()
    if re.match(r"(hi|hello|hey|thanks|thank you)\b", low):
        return "chitchat"
    if re.search(r"\b(compare|versus|vs|difference)\b", low):
        return "comparison"
    if low.startswith("how "):
        return "howto"
    return "factoid" if len(low.split()) <= 12 else "other"


roles.add("summarise", first_sentence)
roles.add("hyde", lambda text: f"{text} {first_sentence(text)}")
roles.add("refine", lambda text: " ".join(sorted(set((text or "").lower().split()))))
roles.add("intent", intent_of)


def answer_stub(asked: str | None) -> str:
    """The stub answer to {question, context: [{cite, text}]}: the first sentence of the first block, cited."""
    context = sorted(json.loads(asked or "{}").get("context") or [], key=lambda x: x["cite"])
    said = first_sentence(context[0].get("text")) if context else ""
    return json.dumps({"answer": said, "claims": [{"text": said, "cite": [context[0]["cite"]]}] if said else []}, ensure_ascii=False)


def answer_parts(asked: str | None) -> Iterator[str]:
    """The stub answer, a word at a time."""
    said = json.loads(answer_stub(asked))["answer"]
    yield from re.findall(r"\S+\s*|\s+", said)


roles.add("answer", answer_stub)
roles.add("answer_parts", answer_parts)
roles.add("direct", lambda text: "Hello! Ask me about the documents.")


def variants(text: str | None, n: int = 4) -> list[str]:
    """Stub variants of a question: rotated words, each without one word."""
    words = (text or "").split()
    return [" ".join(words[k + 1 :] + words[:k]) for k in range(min(n, max(0, len(words) - 1)))]


# --- tracing ---------------------------------------------------------------------------------------------------------------


class Tracer:
    """Flat spans with parents; a table of them goes to feedback.trace_totals."""

    def __init__(self, trace_id: str, clock: Callable[[], float] = time.perf_counter):
        self.trace_id, self.clock, self.spans, self.open = trace_id, clock, [], []

    def span(self, name: str) -> Tracer._Span:
        return Tracer._Span(self, name)

    class _Span:
        def __init__(self, tracer: Tracer, name: str):
            self.tracer = tracer
            self.row = {"trace_id": tracer.trace_id, "span_id": None, "parent_id": None, "name": name, "tokens": 0, "cost": 0.0, "ms": 0.0}

        def __enter__(self) -> Tracer._Span:
            t = self.tracer
            self.row |= {"span_id": len(t.spans), "parent_id": t.open[-1] if t.open else None}
            t.spans.append(self.row)
            t.open.append(self.row["span_id"])
            self.begun = t.clock()
            return self

        def usage(self, tokens: int, cost: float) -> None:
            self.row["tokens"] += tokens
            self.row["cost"] += cost

        def __exit__(self, *_: object) -> None:
            self.row["ms"] = (self.tracer.clock() - self.begun) * 1000
            self.tracer.open.pop()
