"""Recorded probes: escalation, verdicts, refusals and request counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsieve.operators.segments import in_pieces, run_lengths, running_sum

#: Share of planned probes that may escalate, and statuses that reject the method (fixed values).
ESCALATION_SHARE, METHOD_REJECTED = 0.2, (400, 405, 501)
#: Refusals in a row that open a circuit, and the seconds it stays open (fixed values).
TOO_MANY, FORBIDDEN, COOLDOWN_S = 5, 10, 300
LIMITS = {429: TOO_MANY, 403: FORBIDDEN}
REASONS = {429: "TOO_MANY_REQUESTS", 403: "FORBIDDEN"}


def escalation_allowance(planned: Column) -> Column:
    return F.when(planned <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(planned * F.lit(ESCALATION_SHARE)))).cast("long")


def escalation_audit(probes: DataFrame) -> DataFrame:
    """Each probe (pattern_id, seq, planned, escalated) with its decision given the escalations before it."""
    own = F.coalesce(F.col("escalated").cast("long"), F.lit(0))
    probes = running_sum(in_pieces(probes, ["pattern_id"], ["seq"]), ["pattern_id"], ["seq"], own, "_used").drop("piece")
    used = F.col("_used") - own
    allowed = escalation_allowance(F.col("planned"))
    left = F.greatest(F.lit(0), allowed - used)
    decision = F.when(F.col("planned") <= 0, "nothing_to_probe").when(left > 0, "allow").otherwise("suppress")
    return probes.withColumns({"escalated_before": used, "remaining": left, "decision": decision}).drop("_used")


def escalation_summary(probes: DataFrame) -> DataFrame:
    escalated = F.count_if("escalated")
    return probes.groupBy("pattern_id").agg(F.count("*").alias("probed"), escalated.alias("escalated"), (escalated / F.count("*")).alias("escalation_rate"), (F.count("*") + escalated).alias("request_cost"))


def _refusal() -> Column:
    return F.when(F.col("status") == 429, "TOO_MANY_REQUESTS").when(F.col("status") == 403, "FORBIDDEN")


def refusal_runs(probes: DataFrame, key: Sequence[str] = ("host",)) -> DataFrame:
    """Each probe (host, seq, status) with the length so far of its run of equal refusals; any other status ends a run.

    A host's log is counted in pieces; see ``segments``.
    """
    placed = in_pieces(probes.withColumn("refusal", _refusal()), key, ["seq"])
    return run_lengths(placed, key, ["seq"], F.col("refusal"), "in_a_row").drop("piece")


class Circuit:
    """What a host's probes have led to: the refusals in a row (status and count), or until when the circuit is open."""

    def __init__(self, last: int = 0, streak: int = 0, until: float = float("-inf")):
        self.last, self.streak, self.until = last, streak, until

    def takes(self, at: float, status: int) -> bool:
        """Reads a probe; whether it opens the circuit."""
        if at < self.until:
            return False
        if status not in LIMITS:
            self.last, self.streak = 0, 0
            return False
        self.last, self.streak = status, self.streak + 1 if status == self.last else 1
        if self.streak < LIMITS[status]:
            return False
        self.last, self.streak, self.until = 0, 0, at + COOLDOWN_S
        return True


def _piece_exits(at: np.ndarray, status: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, streak, until) after the piece when its counts begin anew at each of its probes; ``until`` is -inf unless the circuit was open at some time."""
    n = len(at)
    # probes from each on that are the same refusal
    ahead = np.ones(n, np.int64)
    for i in range(n - 2, -1, -1):
        if status[i] == status[i + 1]:
            ahead[i] += ahead[i + 1]
    last, streak, until = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
    for i in range(n - 1, -1, -1):
        end = i + ahead[i]
        limit = LIMITS.get(status[i])
        if limit is None or ahead[i] < limit:
            if end < n:
                last[i], streak[i], until[i] = last[end], streak[end], until[end]
            elif limit is not None:
                last[i], streak[i] = status[i], ahead[i]
            continue
        opened = at[i + limit - 1] + COOLDOWN_S
        again = _resumes(at, i + limit, opened)
        if again < n:
            last[i], streak[i], until[i] = last[again], streak[again], max(until[again], opened)
        else:
            until[i] = opened
    return last, streak, until


def _resumes(at: np.ndarray, begin: int, until: float) -> int:
    """The first place from ``begin`` on whose time isn't before ``until``."""
    return begin + int(np.searchsorted(at[begin:], until))


_SUMMARY = "host string, piece long, status long, same long, size long, at array<double>, last array<long>, streak array<long>, until array<double>"


def _pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one host in one piece at a time, of batches in order."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        change = (pdf["host"].fillna("\0") != pdf["host"].fillna("\0").shift()) | (pdf["piece"] != pdf["piece"].shift())
        for _, part in pdf.groupby(change.cumsum(), sort=False):
            if held and (_host(held[0]), held[0]["piece"].iloc[0]) != (_host(part), part["piece"].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _host(part: pd.DataFrame) -> str | None:
    host = part["host"].iloc[0]
    return None if pd.isna(host) else host


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each piece makes of the states it can be entered in.

    Entered with refusals in a row, it is decided by its first run. Entered open,
    it goes on at the first probe after the cooldown, which is no later than the
    cooldown after its first probe.
    """
    for own in _pieces_of(batches):
        at, status = own["at"].to_numpy(float), own["status"].to_numpy(np.int64)
        last, streak, until = _piece_exits(at, status)
        n = len(at)
        same = int(np.argmax(status != status[0])) if (status != status[0]).any() else n
        upto = min(n, _resumes(at, 0, at[0] + COOLDOWN_S) + 1)
        # a run of refusals that was begun before may open the circuit here, or end within the piece
        upto = max(upto, min(n, same + 1))
        places = np.arange(upto)
        if status[0] in LIMITS:
            # where counting goes on after an opening by a run that was begun before
            more = [_resumes(at, k, at[k - 1] + COOLDOWN_S) for k in range(1, min(same, LIMITS[status[0]]) + 1)]
            places = np.unique(np.concatenate([places, [m for m in more if m < n]]).astype(np.int64))
        yield pd.DataFrame([(_host(own), own["piece"].iloc[0], status[0], same, n, at[places], last[places], streak[places], until[places])], columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, piece, last, streak, until) at the start of each piece, from the summaries of a host in order."""
    host, state, first = None, Circuit(), True
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            own = None if pd.isna(row.host) else row.host
            if first or own != host:
                host, state, first = own, Circuit(), False
            out.append((own, row.piece, state.last, state.streak, state.until))
            state = _through(row, state)
        yield pd.DataFrame(out, columns=["host", "piece", "last", "streak", "until"])


def _through(row, state: Circuit) -> Circuit:
    at = np.asarray(row.at)

    def anew(begin: int, until: float) -> Circuit:
        """Counts begin anew at the first listed place from ``begin`` on after ``until``."""
        later = np.flatnonzero(at[begin:] >= until)
        if not len(later):
            return Circuit(until=until)
        k = begin + int(later[0])
        return Circuit(int(row.last[k]), int(row.streak[k]), max(until, float(row.until[k])))

    if state.streak and state.last == row.status:
        limit = LIMITS[state.last]
        need = limit - state.streak
        if row.same < need:
            if row.same == row.size:
                return Circuit(state.last, state.streak + int(row.same), state.until)
            return anew(int(row.same), state.until)
        return anew(int(need), float(at[need - 1]) + COOLDOWN_S)
    return anew(0, state.until)


def refusal_circuits(probes: DataFrame) -> DataFrame:
    """(host, opened_seq, reason) of every opening, with the cooldown: probes (host, seq, at seconds, status), by time and then seq.

    Probes without a time come first. While a circuit is open nothing counts; after ``COOLDOWN_S`` seconds the
    counts begin anew. Each piece of a host's log is summed up for all states it
    can be entered in; a scan over a host's summaries, which are small, gives the
    state at the start of each piece, and from there the pieces are read again,
    all at once.
    """
    rows = probes.select("host", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("at").cast("double"), F.lit(-1e300)).alias("at"), F.coalesce(F.col("status").cast("long"), F.lit(0)).alias("status"))
    placed = in_pieces(rows, ["host"], ["at", "seq"]).select("host", "piece", "seq", "at", "status")
    summed = placed.mapInPandas(_summaries, _SUMMARY)
    entries = summed.repartition("host").sortWithinPartitions("host", "piece").mapInPandas(_entries, "host string, piece long, last long, streak long, until double")

    def openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # state rows come first in their piece
        for own in _pieces_of(batches):
            out, state = [], Circuit()
            for host, seq, at, status, last, streak, until in own[["host", "seq", "at", "status", "last", "streak", "until"]].itertuples(index=False):
                if not pd.isna(until):
                    state = Circuit(int(last), int(streak), until)
                elif state.takes(at, int(status)):
                    out.append((None if pd.isna(host) else host, int(seq), REASONS[int(status)]))
            yield pd.DataFrame(out, columns=["host", "opened_seq", "reason"])

    none = F.lit(None)
    both = placed.select("host", "piece", F.lit(1).alias("row"), "seq", "at", "status", none.cast("long").alias("last"), none.cast("long").alias("streak"), none.cast("double").alias("until")).unionByName(
        entries.select("host", "piece", F.lit(0).alias("row"), none.cast("long").alias("seq"), none.cast("double").alias("at"), none.cast("long").alias("status"), "last", "streak", "until")
    )
    return both.repartition("host", "piece").sortWithinPartitions("host", "piece", "row", "at", "seq").mapInPandas(openings, "host string, opened_seq long, reason string")


def pattern_verdict(probes: DataFrame) -> DataFrame:
    """Verdict of each pattern from its probes (host, pattern_id, seq, status, planned, escalated, is_soft_404).

    The first trigger counts: a refusal run that opens a circuit makes the
    pattern ``blocked``, a rejected method beyond the escalation allowance makes
    it ``needs_review``; otherwise it is ``measured``.
    """
    runs = refusal_runs(probes, ["host", "pattern_id"])
    used = F.col("_used")
    runs = running_sum(in_pieces(runs, ["pattern_id"], ["seq"]), ["pattern_id"], ["seq"], F.col("escalated").cast("long"), "_used")
    opened = (F.col("in_a_row") >= F.when(F.col("refusal") == "TOO_MANY_REQUESTS", TOO_MANY).otherwise(FORBIDDEN)) & F.col("refusal").isNotNull()
    over = F.col("status").isin(*METHOD_REJECTED) & (used > escalation_allowance(F.col("planned")))
    trigger = F.when(opened, F.col("refusal")).when(over, "HEAD_NOT_SUPPORTED")
    marked = runs.withColumn("_trigger", trigger)
    found = marked.groupBy("pattern_id").agg(
        F.min_by("_trigger", F.when(F.col("_trigger").isNotNull(), F.col("seq"))).alias("reason"), F.count("*").alias("probed"), F.count_if("escalated").alias("escalated"),
        F.count_if(F.col("escalated") & F.col("status").between(200, 299)).alias("soft404_sniffed"), F.count_if(~F.col("escalated") & F.col("status").between(200, 299)).alias("soft404_suppressed"),
    )
    return found.withColumn("verdict", F.when(F.col("reason").isNull(), "measured").when(F.col("reason") == "HEAD_NOT_SUPPORTED", "needs_review").otherwise("blocked"))


def probe_requests(probes: DataFrame, *keys: str) -> DataFrame:
    escalated = F.count_if("escalated_to_get")
    return probes.groupBy(*keys).agg(F.count("*").alias("probes"), escalated.alias("get_escalations"), (F.count("*") + escalated).alias("http_requests"), F.count_if(F.col("http_status").isNull()).alias("no_response"))
