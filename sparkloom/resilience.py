"""Models that may fail: retries, even pacing, a cache before and others after, and budgets."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence

from .errors import ConfigError, ProviderError, SparkloomError

RETRIED = {408, 425, 429, *range(500, 600)}
LONGEST_WAIT = 120.0


class BudgetExceeded(SparkloomError):
    """A call that would go beyond what was set."""


def worth_retrying(e: Exception) -> bool:
    status = getattr(e, "status", getattr(e, "status_code", None))
    return isinstance(e, TimeoutError | ConnectionError) or (isinstance(status, int) and status in RETRIED)


def wait_before(attempt: int, hint: float | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before a further attempt (0 up): what the server asks for, else 2, 4, 8 up to 60, with some chance."""
    if hint is not None:
        return min(max(0.0, hint), LONGEST_WAIT)
    return min(60.0, 2.0 * 2**attempt) * (0.5 + jitter() / 2)


def retry(call: Callable, attempts: int = 4, sleep: Callable[[float], None] = time.sleep):
    for n in range(attempts):
        try:
            return call()
        except ConfigError:
            raise
        except Exception as e:
            if n == attempts - 1 or not worth_retrying(e):
                raise ProviderError(f"{type(e).__name__}: {e}") from e
            sleep(wait_before(n, getattr(e, "retry_after", None)))


class RateLimiter:
    """Starts at even distances: per_minute calls in this process, which is one Python worker on an executor."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        start = max(now, self.next)
        self.next = start + self.gap
        if start > now:
            self.sleep(start - now)


class Budget:
    """Calls and characters that may be spent; tested before each call."""

    def __init__(self, calls: int | None = None, chars: int | None = None):
        self.calls, self.chars, self.spent_calls, self.spent_chars = calls, chars, 0, 0

    def before(self, calls: int, chars: int) -> None:
        if (self.calls is not None and self.spent_calls + calls > self.calls) or (self.chars is not None and self.spent_chars + chars > self.chars):
            raise BudgetExceeded(f"{self.spent_calls} calls and {self.spent_chars} characters are spent; this call would go beyond the budget")
        self.spent_calls += calls
        self.spent_chars += chars


class Resilient:
    """A model of several: asks the cache, waits for its turn, tries again, then asks the next one."""

    def __init__(self, models: Sequence[Callable[[list[str]], list[str]]], cache=None, limiter: RateLimiter | None = None, attempts: int = 4, budget: Budget | None = None, sleep: Callable[[float], None] = time.sleep):
        if not models:
            raise ConfigError("at least one model is needed")
        self.models, self.cache, self.limiter, self.attempts, self.budget, self.sleep, self.cache_hits = list(models), cache, limiter, attempts, budget, sleep, 0

    def __call__(self, prompts: list[str]) -> list[str]:
        out = [self.cache.get(p) if self.cache else None for p in prompts]
        open_ = [i for i, r in enumerate(out) if r is None]
        self.cache_hits += len(prompts) - len(open_)
        if open_:
            asked = [prompts[i] for i in open_]
            if self.budget:
                self.budget.before(len(asked), sum(map(len, asked)))
            for i, reply in zip(open_, self._ask(asked)):
                out[i] = reply
                if self.cache:
                    self.cache.put(prompts[i], reply)
        return out

    def _ask(self, prompts: list[str]) -> list[str]:
        for n, model in enumerate(self.models):
            if self.limiter:
                self.limiter.wait()
            try:
                return retry(lambda: model(prompts), self.attempts, self.sleep)
            except ProviderError:
                if n == len(self.models) - 1:
                    raise
        raise AssertionError


class Lazy:
    """A model that is made when it is first asked, in the process that asks."""

    def __init__(self, make: Callable[[], Callable[[list[str]], list[str]]]):
        self.make, self._model = make, None

    def __getstate__(self):
        return {"make": self.make, "_model": None}

    def __call__(self, prompts: list[str]) -> list[str]:
        if self._model is None:
            self._model = self.make()
        return self._model(prompts)
