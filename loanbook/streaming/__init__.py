"""Streaming.

The original application is batch only: it has no stream source, watermark,
window or stateful operator, so nothing here is parity work. What follows
only shows that the per-loan monitoring map (state, 12-step PD, tag, action)
is stateless and therefore runs unchanged on a ``readStream`` of loan
snapshots; the aggregates (A5, A12) stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.operators import migration as M


def tag_stream(stream: DataFrame, tpm=None) -> DataFrame:
    """Per-snapshot monitoring tags on a streaming DataFrame of
    (id, loan_status, ...): status -> state -> PD (4 dp) -> tag -> action."""
    pdt = M.state_pd_table(stream.sparkSession, tpm)
    s = stream.filter(F.col("loan_status").isin(K.ONGOING_STATUSES)) \
              .withColumn("current_state", M.status_to_state("loan_status"))
    s = s.join(F.broadcast(pdt), F.col("current_state") == F.col("state"), "left")
    s = s.withColumn("status_tag", M.risk_tag("current_state")) \
         .withColumn("cumulative_pd", F.rint(F.col("horizon_pd") * 10000) / 10000)
    return s.withColumn("action", M.action_rule()).drop("state", "horizon_pd")
