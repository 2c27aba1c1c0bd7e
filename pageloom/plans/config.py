"""Settings of a crawl and of retries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlConfig:
    """Limits of a crawl.

    ``allowed_domains`` empty means: only links to the host of the page they are
    on.  ``rate_limit`` is in requests per second, ``delay_ms`` in milliseconds;
    both only shape the fetch schedule.
    """

    max_depth: int = 2
    max_pages: int | None = 10
    allowed_domains: tuple[str, ...] = ()
    lower_allowlist: bool = True
    rate_limit: float = 2.0
    delay_ms: int = 500


@dataclass(frozen=True)
class RetryConfig:
    max_retries: int = 3
    initial_delay_s: float = 1.0
    max_delay_s: float = 10.0
    multiplier: float = 2.0


RESULT_TTL_HOURS = 24
