"""Pages of results, revisions of the population they come from, and budgets in tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, BudgetConfig


class StaleCursor(ValueError):
    """The population has changed since the cursor was given."""


def revision(rows: DataFrame, order: str, *columns: str) -> str:
    """A mark of an ordered population: rank and values of each row, whatever the partitions."""
    mark = rows.agg(F.bit_xor(F.xxhash64(order, *columns)), F.count("*")).first()
    return f"{(mark[0] or 0) & (1 << 64) - 1:x}-{mark[1]}"


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    matched: int
    offset: int
    limit: int
    revision: str

    @property
    def next_offset(self) -> int | None:
        return self.offset + self.limit if self.offset + self.limit < self.matched else None

    @property
    def truncated(self) -> bool:
        return self.next_offset is not None


def paginate(ranked: DataFrame, order: str, columns: tuple[str, ...], limit: int, offset: int = 0, since: str | None = None) -> Page:
    """A page of rows that are ranked from 1 in `order`; a cursor from another revision raises StaleCursor."""
    now = revision(ranked, order, *columns)
    if since is not None and since != now:
        raise StaleCursor("STALE_CURSOR")
    return Page(ranked.where((F.col(order) > offset) & (F.col(order) <= offset + limit)), int(now.rsplit("-", 1)[1]), offset, limit, now)


def cap(fixed: int, page_tokens: Column | int, cfg: BudgetConfig = DEFAULTS.budget) -> Column:
    """A response's budget: fixed, or a share of what reading the page would cost."""
    tokens = F.lit(page_tokens) if isinstance(page_tokens, int) else page_tokens
    return F.least(F.lit(fixed), F.greatest(F.lit(cfg.floor), F.round(cfg.share * tokens).cast("int"))) if cfg.adaptive else F.lit(fixed)


def shrink_to(cost, rows: int, most: int, cfg: BudgetConfig = DEFAULTS.budget) -> tuple[int, bool]:
    """Halve the number of rows until cost(rows) fits; (rows, still over). cost is asked for a page's few rows."""
    best = rows
    for _ in range(cfg.max_shrink_steps):
        if cost(best) <= most or best <= 1:
            break
        best = max(1, best // 2)
    return best, cost(best) > most
