"""SQL text fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from loanbook import constants as K
from loanbook.functions.numeric import clip_sql, dbl, round_half_even_sql
from loanbook.operators.migration import horizon_default_pd

rint = round_half_even_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


ONGOING_IN = f"loan_status IN {in_list(K.ONGOING_STATUSES)}"
FINISHED_IN = f"loan_status IN {in_list(K.FINISHED_STATUS_LABEL)}"

STATE_CASE = "CASE loan_status " + " ".join(
    f"WHEN {q(s)} THEN {c}" for s, c in K.ONGOING_STATUS_STATE.items()) + " END"

LABEL_CASE = "CASE loan_status " + " ".join(
    f"WHEN {q(s)} THEN {c}" for s, c in K.FINISHED_STATUS_LABEL.items()) + " END"


def tag_case(state: str) -> str:
    return (f"CASE WHEN {state} = 0 THEN 'stable' WHEN {state} = 1 THEN 'late' "
            f"WHEN {state} = 2 THEN 'attention' WHEN {state} = 3 THEN 'warning' "
            f"ELSE 'default' END")


def pd_case(state: str, tpm=None, steps: int = K.PD_HORIZON_STEPS) -> str:
    pds = horizon_default_pd(tpm, steps)
    return "CASE " + " ".join(f"WHEN {state} = {i} THEN {dbl(v)}" for i, v in enumerate(pds)) + " END"


def lgd_sql(rec: str = "recoveries", funded: str = "funded_amnt",
            missing: float = K.MISSING_LGD, lo: float = 0.0, hi: float = 1.0) -> str:
    raw = (f"CASE WHEN {rec} IS NULL OR {funded} IS NULL THEN {dbl(missing)} "
           f"WHEN {funded} = 0 THEN (CASE WHEN {rec} = 0 THEN {dbl(missing)} "
           f"WHEN {rec} > 0 THEN {dbl(lo)} ELSE {dbl(hi)} END) "
           f"ELSE 1 - {rec} / {funded} END")
    return clip_sql(raw, lo, hi)


def action_case(tag: str = "status_tag", pd: str = "cumulative_pd") -> str:
    parts = " ".join(
        f"WHEN {tag} = {q(name)} THEN (CASE WHEN {pd} > {dbl(thr)} THEN {q(a)} ELSE {q(b)} END)"
        for name, thr, a, b in K.ACTION_RULES)
    return f"CASE {parts} ELSE {q(K.DEFAULT_ACTION)} END"


__all__ = ["rint", "clip_sql", "dbl", "q", "in_list", "ONGOING_IN", "FINISHED_IN",
           "STATE_CASE", "LABEL_CASE", "tag_case", "pd_case", "lgd_sql", "action_case"]
