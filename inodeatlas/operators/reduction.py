"""Slot order and reduction rules of change-log batches.

Within one poll batch, events of one object form a slot. Slots follow each other in
the order of their first event, and a rule may drop a new event or cancel an earlier
one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import known_events
from ..schemas import FID_RULES, INOTIFY_RULES


def slot_key(profile: str) -> Column:
    """Inode, or fid; a rename belongs to the object that moves."""
    if profile == "inotify":
        return F.col("inode").cast("string")
    moved = F.col("event_type") == "08RENME"
    return F.when(moved, F.col("source_fid")).otherwise(F.col("target_fid"))


def drop_event_types(events: DataFrame, spec: str | None) -> DataFrame:
    """Leave out the event types of a comma-separated list; unknown names have no effect."""
    names = [n.strip() for n in (spec or "").split(",") if n.strip()]
    return events.filter(~F.col("event_type").isin(*names)) if names else events


def unknown_event_types(spec: str | None, profile: str) -> list[str]:
    names = [n.strip() for n in (spec or "").split(",") if n.strip()]
    return [n for n in names if n not in known_events(profile)]


def slot_order(events: DataFrame, profile: str) -> DataFrame:
    """Add ``slot`` and ``first_eid``; (batch_id, first_eid, eid) is the processing order."""
    slotted = events.withColumn("slot", slot_key(profile))
    first = F.min("eid").over(Window.partitionBy("batch_id", "slot"))
    return slotted.withColumn("first_eid", first)


def _brackets(rules: dict) -> list[tuple[tuple[str, ...], list[str]]]:
    """(openers, closers) of the cancelling rules: a closer takes the latest opener and itself away."""
    out: dict[tuple[str, ...], list[str]] = {}
    for event, (action, targets) in rules.items():
        if action == "cancel":
            out.setdefault(tuple(targets), []).append(event)
    return list(out.items())


def _ignored(rules: dict, openers: set[str]) -> dict[frozenset[str], dict[str, set[str]]]:
    """By the lasting events that block them, the ignorable events and the openers that block each.

    A lasting event is one that no rule takes away again. Those of a group must block each other, so that
    only the first of them stays.
    """
    groups: dict[frozenset[str], dict[str, set[str]]] = {}
    for event, (action, targets) in rules.items():
        if action == "ignore":
            groups.setdefault(frozenset(targets) - openers, {})[event] = set(targets) & openers
    for lasting, events in groups.items():
        if not lasting <= set(events):
            raise ValueError(f"events that block others but do not block each other: {sorted(lasting - set(events))}")
    return groups


def reduce_events(events: DataFrame, profile: str, enabled: bool = True) -> DataFrame:
    """Events that survive the rules, with ``slot`` and ``first_eid``.

    Needs ``batch_id`` and ``eid``. The order of slots holds even without rules, and
    ``first_eid`` stays that of a first event that was cancelled later.

    Openers and closers are matched like brackets, by running counts: the depth after an event is the number
    of openers that stand open. A closer that finds one open goes; so does an opener if the depth later falls
    below its own. A barrier starts the count anew, and what stands open before it stays. Slots are sorted, and
    never held as lists.
    """
    slotted = slot_order(events, profile)
    if not enabled:
        return slotted
    rules = INOTIFY_RULES if profile == "inotify" else FID_RULES
    barrier = () if profile == "inotify" else ("08RENME",)
    kind = F.col("event_type")
    slot = Window.partitionBy("batch_id", "slot")
    upto = slot.orderBy("eid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = slot.orderBy("eid").rowsBetween(Window.unboundedPreceding, -1)
    part = Window.partitionBy("batch_id", "slot", "_part")
    out = slotted.withColumn("_part", F.count_if(kind.isin(*barrier)).over(upto) if barrier else F.lit(0))
    keep, open_before = F.lit(True), {}
    brackets = _brackets(rules)
    for i, (openers, closers) in enumerate(brackets):
        opens, closes = kind.isin(*openers), kind.isin(*closers)
        step = F.when(opens, 1).when(closes, -1).otherwise(0)
        running = part.orderBy("eid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"_sum{i}", F.sum(step).over(running))
        out = out.withColumn(f"_depth{i}", F.col(f"_sum{i}") - F.least(F.lit(0), F.min(f"_sum{i}").over(running)))
        out = out.withColumn(f"_was{i}", F.lag(f"_depth{i}", 1, 0).over(part.orderBy("eid")))
        if barrier:  # what the earlier parts have left open
            last = F.coalesce(F.lead("_part").over(slot.orderBy("eid")) != F.col("_part"), F.lit(True))
            out = out.withColumn(f"_left{i}", F.when(last, F.col(f"_depth{i}")))
            out = out.withColumn(f"_open{i}", F.col(f"_was{i}") + F.coalesce(F.sum(f"_left{i}").over(before), F.lit(0)))
        else:
            out = out.withColumn(f"_open{i}", F.col(f"_was{i}"))
        open_before |= {o: F.col(f"_open{i}") > 0 for o in openers}
        later = part.orderBy(F.desc("eid")).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"_later{i}", F.min(f"_depth{i}").over(later))
        taken = (closes & (F.col(f"_was{i}") > 0)) | (opens & F.coalesce(F.col(f"_later{i}") < F.col(f"_depth{i}"), F.lit(False)))
        keep = keep & ~taken
    for i, (lasting, ignorable) in enumerate(_ignored(rules, set(open_before)).items()):
        free = F.lit(False)
        for event, blockers in ignorable.items():
            blocked = F.lit(False)
            for opener in sorted(blockers):
                blocked = blocked | open_before[opener]
            free = free | ((kind == event) & ~blocked)
        out = out.withColumn(f"_free{i}", free)
        first = F.min(F.when(F.col(f"_free{i}") & kind.isin(*sorted(lasting)), F.col("eid"))).over(slot)
        out = out.withColumn(f"_first{i}", first)
        stays = F.col(f"_free{i}") & (F.col(f"_first{i}").isNull() | (F.col("eid") <= F.col(f"_first{i}")))
        keep = keep & (~kind.isin(*ignorable) | stays)
    return out.filter(keep).select(*events.columns, "slot", "first_eid")


def pass_through(events: DataFrame, profile: str, enabled: bool = True) -> DataFrame:
    """Feed without namespace state: the reduced events themselves."""
    return reduce_events(events, profile, enabled)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def reader_audit(tagged: DataFrame, ignored: str | None = None) -> DataFrame:
    """Polled = errors + ignored + emitted, over rows that carry ``reject`` and event_type."""
    names = [n.strip() for n in (ignored or "").split(",") if n.strip()]
    bad = F.col("reject").isNotNull()
    skipped = ~bad & F.col("event_type").isin(*names) if names else F.lit(False)
    return tagged.agg(
        F.count("*").alias("polled"),
        F.count_if(bad).alias("errors"),
        F.count_if(skipped).alias("ignored"),
        F.count_if(~bad & ~skipped).alias("emitted"),
    )


def reduction_audit(events: DataFrame, profile: str) -> DataFrame:
    """Received, reduced and accepted events per batch."""
    received = events.groupBy("batch_id").agg(F.count("*").alias("received"))
    kept = reduce_events(events, profile).groupBy("batch_id").agg(F.count("*").alias("accepted"))
    return received.join(kept, "batch_id", "left").select(
        "batch_id",
        "received",
        (F.col("received") - F.coalesce("accepted", F.lit(0))).alias("reduced"),
        F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"),
    )


def event_rate(events: DataFrame, seconds: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events per second between the first and the last event; null for a single moment."""
    span = F.max(seconds) - F.min(seconds)
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"),
        span.alias("seconds"),
        F.try_divide(F.count("*").cast("double"), span.cast("double")).alias("per_second"),
    )
