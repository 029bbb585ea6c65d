"""Raw readings of a network to cleaned readings, as one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thawline.functions.tables import PLAUSIBLE
from thawline.operators import filters as FL, quality as Q, spikes as S
from thawline.sources import cut_lineage


def cleaned_readings(readings: DataFrame, rules: DataFrame, network: str, window=PLAUSIBLE, correct_bias: bool | None = None,
                     spacing: tuple[int, ...] = (10, 15), max_step: float = 0.125,
                     n_blocks: int | None = None) -> DataFrame:
    """`readings` hold one row per site, logger and stamp.

    Only the network with out-of-field spells corrects sensor bias. Rows inserted in gaps would have no code and
    leave again with the out-of-field rows, so none are inserted here.

    Lineage is cut where several later steps start from one result: they read it back
    instead of recomputing everything before it, and a lost executor costs one step.
    """
    correct_bias = network == "oulu" if correct_bias is None else correct_bias
    visits = Q.last_visit(readings)
    df = cut_lineage(Q.mask_visits(FL.in_window(readings, "datetime", *window, closed=False), visits))
    diag = cut_lineage(Q.apply_quality(Q.daily_diagnostics(df), rules))
    work = df
    if correct_bias:
        work = Q.apply_offsets(df, Q.sensor_offsets(df, diag, max_step))
    field = cut_lineage(Q.mask_incomplete_days(Q.drop_office(work, diag)))
    base = cut_lineage(FL.regular_spacing(field.filter(F.col("probl") != 1), spacing))
    own = S.own_rows(S.sensor_rows(base), network)
    corrected = S.correct_spikes(own, field, network, n_blocks)
    return FL.apply_limits(S.assemble_clean(base, corrected), network)
