"""Ledger and lease operators, cost, back-off, circuit breaking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Prices are per million tokens."""
    return ((input_tokens * input_price + output_tokens * output_price) / 1_000_000).cast("decimal(18,8)")


def remaining(shards: DataFrame) -> DataFrame:
    """What a tenant can still spend."""
    return shards.groupBy("tenant_id").agg(F.sum(F.col("cap") - F.col("spent") - F.col("reserved")).alias("remaining"))


def idempotent_ledger(entries: DataFrame, order: str = "created_at") -> DataFrame:
    """ST12: the first entry of each (run_id, request_id)."""
    names = [c for c in entries.columns if c not in ("run_id", "request_id")]
    best = entries.groupBy("run_id", "request_id").agg(F.min_by(F.struct(*names), F.struct(order, *[c for c in names if c != order])).alias("r"))
    return best.select("run_id", "request_id", "r.*")


def expired_leases(leases: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """J22, ST11: leases past their time that no ledger row settled."""
    return leases.filter(F.col("expires_at") <= now).join(ledger.select("run_id", "request_id").distinct(), ["run_id", "request_id"], "left_anti")


def reconcile(shards: DataFrame, leases: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows release what their lease reserved and add what was spent; without a lease the lowest shard is charged."""
    lowest = shards.groupBy("tenant_id").agg(F.min("shard").alias("lowest"))
    once = idempotent_ledger(ledger)
    charged = once.join(leases.select("run_id", "request_id", F.col("shard").alias("l_shard"), F.col("reserved").alias("released")), ["run_id", "request_id"], "left").join(lowest, "tenant_id")
    per = charged.groupBy("tenant_id", F.coalesce("l_shard", "lowest").alias("shard")).agg(F.sum("cost_usd").alias("cost"), F.sum(F.coalesce("released", F.lit(0))).alias("released"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return shards.join(per, ["tenant_id", "shard"], "left").select("tenant_id", "shard", (F.col("reserved") - zero("released")).alias("reserved"), (F.col("spent") + zero("cost")).alias("spent"), "cap")


def reserve(requests: DataFrame, caps: DataFrame) -> DataFrame:
    """Requests (tenant_id, request_id, seq, estimate) in order against a cap: granted while the sum fits; a repeated
    request id is granted as before. An ordered fold per tenant."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, seen, out = 0.0, {}, []
        for r in pdf.sort_values("seq").itertuples():
            if r.request_id not in seen:
                seen[r.request_id] = used + r.estimate <= r.cap + 1e-9
                used += r.estimate if seen[r.request_id] else 0.0
            out.append((r.tenant_id, r.request_id, r.seq, seen[r.request_id]))
        return pd.DataFrame(out, columns=["tenant_id", "request_id", "seq", "granted"])

    kinds = dict(requests.dtypes)
    schema = f"tenant_id {kinds['tenant_id']}, request_id {kinds['request_id']}, seq {kinds['seq']}, granted boolean"
    return requests.join(caps, "tenant_id").groupBy("tenant_id").applyInPandas(fold, schema)


def stepped_backoff(steps: list[float], attempt: Column, last_status: Column | None = None) -> Column:
    """The step of an attempt, the last one after them all; the first again after a status under 400."""
    at = F.least(F.greatest(attempt, F.lit(1)), F.lit(len(steps))).cast("int")
    step = F.element_at(F.array(*map(F.lit, steps)), at)
    return step if last_status is None else F.when(last_status < 400, steps[0]).otherwise(step)


#: The first cooldown, and the longest one in seconds by kind of error and for any other.
COOLDOWN_BASE, COOLDOWN_CAPS, COOLDOWN_CAP = 60.0, {"auth_error": 3600, "rate_limited": 600}, 300


def cooldown(failures: Column, kind: Column, base: float = COOLDOWN_BASE) -> Column:
    """Seconds to wait from the third failure on, doubling up to the cap of the kind."""
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COOLDOWN_CAPS.items() for x in kv)), kind), F.lit(COOLDOWN_CAP))
    return F.when(failures >= 3, F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(failures - 3, F.lit(20))), cap.cast("double"))).otherwise(0.0)


def circuit_states(calls: DataFrame, keys: list[str], threshold: int = 5, timeout_s: float = 60.0, closing: int = 2) -> DataFrame:
    """ST9: calls (keys, ts seconds, outcome ok|fail|neutral) in order through closed, open and half-open; whether each was
    let through and the state after it."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, failures, good, opened, out = "closed", 0, 0, 0.0, []
        for r in pdf.sort_values("ts").to_dict("records"):
            if state == "open" and r["ts"] - opened >= timeout_s:
                state, good = "half_open", 0
            passed = state != "open"
            if passed and r["outcome"] == "fail":
                failures += 1
                if state == "half_open" or failures >= threshold:
                    state, opened, failures = "open", r["ts"], 0
            elif passed and r["outcome"] == "ok":
                failures, good = 0, good + 1
                if state == "half_open" and good >= closing:
                    state = "closed"
            out.append((*(r[k] for k in keys), r["ts"], passed, state))
        return pd.DataFrame(out, columns=[*keys, "ts", "passed", "state"])

    kinds = dict(calls.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"ts {kinds['ts']}", "passed boolean", "state string"])
    return calls.groupBy(*keys).applyInPandas(fold, schema)


def error_kind(status: Column, message: Column) -> Column:
    """What went wrong, by status and else by message; a timeout is told before other server errors."""
    by_status = F.when(status.isin(401, 403), "auth").when(status == 429, "rate_limit").when(status == 404, "not_found").when(status == 400, "format").when(status.isin(408, 504), "timeout").when(status >= 500, "server")
    m = F.lower(F.coalesce(message, F.lit("")))
    by_text = F.when(m.rlike("rate.?limit|too many"), "rate_limit").when(m.rlike("unauthori|forbidden|api.?key"), "auth").when(m.rlike("context.*(length|window)|too long"), "context_overflow")
    by_text = by_text.when(m.rlike("time.?out|timed out"), "timeout").when(m.rlike("connect|refused|reset"), "connection").otherwise("unknown")
    return F.coalesce(by_status, by_text)
