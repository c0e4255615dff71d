"""Calls of tools and models: strict arguments, risk, time limits, retries, and a record of each call.

Nothing here touches data; tools are functions that run Spark queries.
"""

from __future__ import annotations

import asyncio
import concurrent.futures as futures
import json
import random
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

# Kinds of error, and what is said of each.
MESSAGES = {
    "invalid_arguments": "调用参数不符合工具要求，自动修复后仍无法执行。",
    "timeout": "服务响应超时，已完成自动重试，请稍后再试。",
    "rate_limited": "服务当前请求过多，已完成自动重试，请稍后再试。",
    "service_unavailable": "依赖服务暂时不可用，已完成自动重试，请稍后再试。",
    "empty_result": "调用成功，但没有返回可用结果。",
    "bad_request": "依赖服务拒绝了本次请求，请检查服务配置。",
    "unauthorized": "依赖服务认证失败，请检查凭据配置。",
    "forbidden": "依赖服务拒绝访问，请检查账号权限。",
    "tool_not_found": "请求的工具不存在或未启用。",
    "risk_denied": "高风险操作未获得可信授权，已阻止执行。",
    "internal_error": "调用过程中发生不可恢复的内部错误。",
}
UNKNOWN = "调用失败，暂时无法完成请求。"
#: Errors that may pass by themselves.
TRANSIENT = {"timeout", "rate_limited", "service_unavailable"}
_BY_STATUS = {429: "rate_limited", 400: "bad_request", 401: "unauthorized", 403: "forbidden"} | dict.fromkeys((408, 500, 502, 503, 504), "service_unavailable")
_BY_NAME = (("timeout", "timeout"), ("ratelimit", "rate_limited"), ("rate_limit", "rate_limited"), ("connection", "service_unavailable"), ("serviceunavailable", "service_unavailable"))
#: Longest question or term, and longest JSON of filters, in characters.
MOST_TEXT, MOST_JSON = 2000, 4000


class InvalidArguments(ValueError):
    """Arguments that a schema rejects; `problems` has (field, what is wrong)."""

    def __init__(self, problems: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{f}: {p}" for f, p in problems))
        self.problems = problems


# --- schemas -----------------------------------------------------------------------------

_MISSING = object()
Check = Callable[[Any], Any]


@dataclass(frozen=True)
class Field:
    """A named argument: a check that returns the value to use or raises ValueError, and a default."""

    check: Check
    default: Any = _MISSING


def text(most: int = MOST_TEXT, pattern: str | None = None) -> Check:
    def check(value: Any) -> str:
        if not isinstance(value, str):
            raise ValueError("must be a text")
        value = value.strip()
        if not 1 <= len(value) <= most:
            raise ValueError(f"must have 1 to {most} characters")
        if pattern and not re.search(pattern, value):
            raise ValueError(f"must match {pattern}")
        return value

    return check


def one_of(*choices: str) -> Check:
    def check(value: Any) -> str:
        if value not in choices:
            raise ValueError(f"must be one of {', '.join(choices)}")
        return value

    return check


def whole(least: int, most: int) -> Check:
    def check(value: Any) -> int:
        if type(value) is not int or not least <= value <= most:
            raise ValueError(f"must be a whole number from {least} to {most}")
        return value

    return check


def flag(value: Any) -> bool:
    if type(value) is not bool:
        raise ValueError("must be true or false")
    return value


def number(value: Any) -> int | float:
    if type(value) not in (int, float) or value != value or value in (float("inf"), float("-inf")):
        raise ValueError("must be a finite number")
    return value


def several(check: Check, least: int, most: int) -> Check:
    def run(value: Any) -> list:
        if not isinstance(value, list) or not least <= len(value) <= most:
            raise ValueError(f"must be a list of {least} to {most}")
        return [check(x) for x in value]

    return run


def maybe(check: Check) -> Check:
    return lambda value: None if value is None else check(value)


def json_object(value: Any) -> dict:
    if not isinstance(value, dict):
        raise ValueError("must be an object")
    try:
        size = len(json.dumps(value, ensure_ascii=False))
    except (TypeError, ValueError) as e:
        raise ValueError("must be JSON") from e
    if size > MOST_JSON:
        raise ValueError("is too long")
    return value


def anything(value: Any) -> Any:
    return value


@dataclass(frozen=True)
class Schema:
    """The fields of a call's arguments, none besides them, and a rule over all of them."""

    fields: dict[str, Field]
    rule: Callable[[dict], str | None] = field(default=lambda values: None)

    def __call__(self, values: Any) -> dict[str, Any]:
        """The arguments as plain values with defaults, or InvalidArguments. Usable as a check of a field itself."""
        if not isinstance(values, dict):
            raise InvalidArguments([("", "must be an object")])
        problems = [(name, "is unknown") for name in values if name not in self.fields]
        out = {}
        for name, f in self.fields.items():
            if name not in values:
                if f.default is _MISSING:
                    problems.append((name, "is missing"))
                else:
                    out[name] = list(f.default) if isinstance(f.default, list) else f.default
                continue
            try:
                out[name] = f.check(values[name])
            except InvalidArguments as e:
                problems += [(f"{name}.{inner}", p) for inner, p in e.problems]
            except ValueError as e:
                problems.append((name, str(e)))
        if not problems and (wrong := self.rule(out)):
            problems.append(("", wrong))
        if problems:
            raise InvalidArguments(problems)
        return out


# Kinds of task that a structured query may have.
TASKS = ("fact", "compare", "contrast", "multi_aspect", "multi_constraint_exclude", "filter", "exclude", "aggregation")
MODE = {"mode": Field(one_of("vector", "bm25", "hybrid"), "hybrid"), "use_reranker": Field(flag, True)}
STRUCTURED_QUERY = Schema(
    {
        "task_type": Field(one_of(*TASKS)),
        "original_query": Field(text()),
        "rewritten_query": Field(text()),
        "sub_queries": Field(several(text(), 1, 3)),
        "filters": Field(json_object),
        "use_history": Field(flag),
        "exclude_terms": Field(several(text(), 0, 10), []),
        "required_terms": Field(several(text(), 0, 10), []),
        "top_k": Field(whole(1, 30), 5),
    }
)
SEARCH = Schema({"query": Field(text()), **MODE})
STRUCTURED_SEARCH = Schema({"structured_query": Field(STRUCTURED_QUERY), **MODE})
REPORT_SEARCH = Schema(
    {"query": Field(maybe(text()), None), "structured_query": Field(maybe(STRUCTURED_QUERY), None), **MODE},
    lambda v: "query or structured_query is needed" if v["query"] is None and v["structured_query"] is None else None,
)
CONTEXT = Schema({"doc_id": Field(text()), "chunk_id": Field(text()), "before": Field(whole(0, 3), 1), "after": Field(whole(0, 3), 1)})
CATALOG = Schema({"company": Field(maybe(text()), None), "year": Field(maybe(text(pattern=r"^\d{4}$")), None), "limit": Field(whole(1, 100), 20)})
MESSAGES_IN = Schema({"messages": Field(several(anything, 1, 50))})


def _metric_rule(v: dict) -> str | None:
    if v["operation"] != "sum" and len(v["values"]) != 2:
        return f"{v['operation']} takes two values"
    base = {"ratio": 1, "growth_rate": 1, "gross_margin": 0}.get(v["operation"])
    return f"the base of {v['operation']} is zero" if base is not None and not v["values"][base] else None


METRIC = Schema({"operation": Field(one_of("sum", "difference", "ratio", "growth_rate", "gross_margin")), "values": Field(several(number, 1, 20)), "precision": Field(whole(0, 8), 4)}, _metric_rule)


def structured_query(payload: Any, original_query: str) -> dict[str, Any]:
    """A model's structured query, checked strictly; the user's own question replaces whatever it says of it."""
    if not isinstance(payload, dict):
        raise InvalidArguments([("", "must be an object")])
    return STRUCTURED_QUERY({**payload, "original_query": original_query})


# --- calls -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tool:
    name: str
    schema: Schema
    risk: str = "read_only"  # read_only, model or high
    seconds: float = 45.0
    attempts: int = 3
    description: str = ""


@dataclass
class Observation:
    """What is kept of a call."""

    tool: str
    status: str  # success or failed
    result: Any
    error_type: str | None = None
    retryable: bool = False
    attempts: int = 0
    duration_ms: int = 0

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass
class Outcome:
    value: Any
    observation: Observation


def default_tools() -> list[Tool]:
    models = [Tool(f"llm.{n}", MESSAGES_IN, "model", 30.0) for n in ("query_rewrite", "query_repair", "query_generalize", "answer")]
    return [
        *models,
        Tool("rag_search", SEARCH),
        Tool("structured_rag_search", STRUCTURED_SEARCH),
        Tool("report_search", REPORT_SEARCH, description="统一执行普通或结构化研报检索"),
        Tool("context_expand", CONTEXT, description="按 doc_id/chunk_id 读取相邻研报片段"),
        Tool("report_catalog", CATALOG, description="查询当前知识库中的研报清单"),
        Tool("metric_calculate", METRIC, attempts=1, description="执行受限的金融指标算术计算"),
    ]


def error_type(error: BaseException) -> str:
    """The kind of an error: by type, by the status of a response, by name."""
    if isinstance(error, (json.JSONDecodeError, InvalidArguments, TypeError)):
        return "invalid_arguments"
    if isinstance(error, (TimeoutError, asyncio.TimeoutError, futures.TimeoutError)):
        return "timeout"
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    name = type(error).__name__.lower()
    return _BY_STATUS.get(status) or next((kind for part, kind in _BY_NAME if part in name), "internal_error")


def said(error: BaseException) -> Any:
    """An error as it may be kept: the fields of bad arguments, else its text without secrets."""
    if isinstance(error, InvalidArguments):
        return [{"field": f, "problem": p} for f, p in error.problems]
    return re.sub(r"(?i)(api[_-]?key\s*[=:]\s*)[^\s,;]+", r"\1***", str(error) or type(error).__name__)[:1000]


def retry_after(error: BaseException, most: float) -> float | None:
    """Seconds that a response asks to wait, at most `most`."""
    headers = getattr(getattr(error, "response", None), "headers", None) or {}
    try:
        return max(0.0, min(float(headers.get("retry-after") or headers.get("Retry-After")), most))
    except (TypeError, ValueError):
        return None


def is_empty(value: Any) -> bool:
    """No value, a blank text or one that says so, or an empty list; an object never is."""
    if isinstance(value, str):
        return value.strip().lower() in ("", "no_data", "not_found")
    return value is None or isinstance(value, (list, tuple, set)) and not value


def summary(value: Any) -> dict[str, Any]:
    """A result in a few words."""
    if isinstance(value, dict):
        return {"doc_count": len(value["docs"])} if isinstance(value.get("docs"), list) else {"keys": sorted(map(str, value))[:20]}
    content = getattr(value, "content", value if isinstance(value, str) else None)
    if content is not None:
        return {"content_chars": len(str(content))}
    return {"item_count": len(value)} if isinstance(value, (list, tuple, set)) else {"type": type(value).__name__}


def friendly(observation: dict[str, Any]) -> str:
    return MESSAGES.get(observation.get("error_type"), UNKNOWN)


class Calls:
    """Tools with their functions, and every call through the same steps."""

    def __init__(self, tools: Iterable[Tool] | None = None, workers: int = 4, base: float = 0.5, most: float = 4.0, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> None:
        self.tools = {t.name: t for t in (default_tools() if tools is None else tools)}
        self.handlers: dict[str, Callable[..., Any]] = {}
        self.base, self.most, self.sleep, self.chance = base, most, sleep, chance
        self.pool = futures.ThreadPoolExecutor(max(1, workers), thread_name_prefix="calls")

    def register(self, tool: Tool, handler: Callable[..., Any] | None = None) -> None:
        self.tools[tool.name] = tool
        if handler is not None:
            self.bind(tool.name, handler)

    def bind(self, name: str, handler: Callable[..., Any]) -> None:
        if name not in self.tools:
            raise ValueError(f"unknown tool {name!r}")
        if not callable(handler):
            raise TypeError("a handler is a function")
        self.handlers[name] = handler

    def listed(self) -> list[dict[str, Any]]:
        """The tools that are no models, and whether each can be called."""
        return [{"name": t.name, "description": t.description, "risk_level": t.risk, "ready": t.name in self.handlers} for t in self.tools.values() if not t.name.startswith("llm.")]

    def call(self, name: str, args: dict[str, Any], function: Callable[..., Any] | None = None, *, approved: bool = False, repairable: bool = True, empty_retryable: bool = True, empty: Callable[[Any], bool] = is_empty, summarise: Callable[[Any], Any] = summary) -> Outcome:
        """The outcome of a tool's function, or of its handler, with checked arguments.

        Transient errors are tried again with the same arguments after growing
        waits; all others end the call.
        """
        began = time.monotonic()
        tool, run = self.tools.get(name), function or self.handlers.get(name)

        def ended(kind: str, what: Any, attempts: int, retryable: bool = False) -> Outcome:
            return Outcome(None, Observation(name, "failed", {"error": what}, kind, retryable, attempts, self._ms(began)))

        if tool is None or run is None:
            return ended("tool_not_found", "the tool is not registered" if tool is None else "the tool has no function", 0)
        if tool.risk == "high" and not approved:
            return ended("risk_denied", "a call of high risk without approval", 0)
        try:
            checked = tool.schema(args)
        except InvalidArguments as e:
            return ended("invalid_arguments", said(e), 0, repairable)
        for attempt in range(1, max(1, tool.attempts) + 1):
            future = self.pool.submit(run, **checked)
            try:
                value = future.result(timeout=tool.seconds)
            except Exception as e:
                future.cancel()
                kind = error_type(e)
                if kind not in TRANSIENT or attempt >= tool.attempts:
                    return ended(kind, said(e), attempt, kind == "invalid_arguments" and repairable)
                wait = retry_after(e, self.most)
                self.sleep(self.wait(attempt) if wait is None else wait)
                continue
            nothing = empty(value)
            return Outcome(value, Observation(name, "success", summarise(value), "empty_result" if nothing else None, nothing and empty_retryable, attempt, self._ms(began)))
        raise AssertionError("a call ends in its last attempt")

    def wait(self, attempt: int) -> float:
        """Seconds before the next attempt: doubled each time up to the most, and up to a quarter more by chance."""
        return min(self.most, self.base * 2 ** max(0, attempt - 1)) * (1 + 0.25 * self.chance())

    @staticmethod
    def _ms(began: float) -> int:
        return max(0, int((time.monotonic() - began) * 1000))
