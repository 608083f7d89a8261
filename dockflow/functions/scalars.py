"""Scalar column helpers: status words, capacity, activity bit, texts, score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockflow.schemas import MONITORED_MEAN, STATE_COLOURS, STATE_ORDER


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def status_flag(column: Column | str, words: Mapping[str, int]) -> Column:
    """1 for the words that map to 1; 0 for every other word and for null."""
    on = [word for word, value in words.items() if value == 1]
    return F.when(_col(column).isin(on), 1).otherwise(0)


def state_code(column: Column | str, words: Mapping[str, int]) -> Column:
    """Known words become their digit (as text); unknown words stay as they are."""
    out = _col(column)
    for word, value in words.items():
        out = F.when(_col(column) == word, F.lit(str(value))).otherwise(out)
    return out


def capacity(places: Column | str = "NBPLACES", bikes: Column | str = "NBVELOS") -> Column:
    return _col(places) + _col(bikes)


def activity_bit(column: Column | str = "transactions_out") -> Column:
    """Value limited to 0..1; null stays null."""
    c = _col(column)
    return F.when(c > 1, 1).when(c < 0, 0).otherwise(c)


def point_part(column: Column | str, index: int) -> Column:
    """Part 0 (latitude) or 1 (longitude) of a ``"lat,lon"`` text."""
    return F.trim(F.split(_col(column), ",", 2)[index]).cast("double")


def parameter_map(column: Column | str) -> Column:
    """``"a=1, b=2"`` as a map; blanks around keys and values do not count."""
    return F.str_to_map(F.regexp_replace(_col(column), r"\s*([,=])\s*", "$1"), F.lit(","), F.lit("="))


def anomaly_probability(decision: Column | str, k: float = 20) -> Column:
    """Logistic curve turned round: decision 0 is 0.5, clear anomalies tend to 1."""
    return 1 / (1 + F.exp(F.lit(float(k)) * _col(decision)))


def station_state(
    mean_activity: Column | str = "mean_activity",
    is_anomaly: Column | str = "is_anomaly",
    is_inactive: Column | str = "is_inactive",
    threshold: float = MONITORED_MEAN,
) -> Column:
    """State of a station; inactive beats anomaly beats not monitored beats normal."""
    # The names of the states.
    return (
        F.when(_col(is_inactive) == 1, "inactive")
        .when(_col(is_anomaly) == 1, "anomaly")
        .when(_col(mean_activity) < threshold, "non surveillée")
        .otherwise("normal")
    )


def _lookup(column: Column | str, values: Mapping) -> Column:
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.create_map(*pairs)[_col(column)]


def state_colour(column: Column | str = "etat") -> Column:
    return _lookup(column, STATE_COLOURS)


def state_rank(column: Column | str = "etat") -> Column:
    return _lookup(column, STATE_ORDER)


def hover_text(
    name: Column | str = "NOM",
    station: Column | str = "station_id",
    bikes: Column | str = "available_bikes",
    since: Column | str = "anomaly_since_str",
) -> Column:
    """Text shown over a station on the map. A missing value reads ``nan``, it does not void the text."""

    def shown(c):
        return F.coalesce(_col(c).cast("string"), F.lit("nan"))

    # The wording on the map.
    return F.concat(
        shown(name),
        F.lit(" <br />station N° : "),
        shown(station),
        F.lit(" <br />Nombre de vélo dispo : "),
        shown(bikes),
        F.lit(" <br />Activité suspecte depuis : "),
        shown(since),
    )
