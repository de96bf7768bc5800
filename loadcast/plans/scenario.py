"""Named scenarios: which series, how much history, which noise, which splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import CYCLE_COLUMNS, TIME_PARTS, time_cycle, time_parts
from loadcast.functions.columns import NOISE_SUFFIX
from loadcast.functions.noise import add_noise
from loadcast.operators.bounds import local_if_bounded
from loadcast.operators.clean import union_days
from loadcast.operators.encode import apply_codes, label_encode, label_fit
from loadcast.operators.sample import sample_per_group
from loadcast.operators.scale import column_std, fit_scaler, scale_transform
from loadcast.operators.split import SplitCuts, fit_split, split_rows
from loadcast.operators.windows import (
    flat_arrays,
    flat_matrix,
    flat_windows,
    panel_frame,
    panel_windows,
    sequence_windows,
    step_columns,
    window_country_id,
)
from loadcast.plans.evaluate import Predict, PredictInputs, evaluate
from loadcast.sources.measurements import filter_countries

VALUE = "quantity_MW"
# Shares of training, validation and test rows; noise level; seed.
SHARES = (0.8, 0.15, 0.05)
NOISE_LEVEL = 0.01
SEED = 42
DAY = 24
ALL_COUNTRIES = ("FR", "ES", "PT")
BASE_FEATURES = ("country", VALUE, *CYCLE_COLUMNS, "year")
GROUPS = ("split", "country")
# Inputs of an encoder-decoder model, and the length of a step's vector.
KNOWN = ("time_idx", *TIME_PARTS)
PANEL_INPUTS: Mapping[str, int | None] = {"encoder_target": None, "encoder_known": len(KNOWN), "decoder_known": len(KNOWN), "static": None}


@dataclass(frozen=True)
class Scenario:
    """One case. ``seq_len`` is the history a model may see, ``lag`` the width it was trained on."""

    name: str
    countries: tuple[str, ...]
    lag: int = 10 * DAY
    lead: int = 3 * DAY
    seq_len: int = 10 * DAY
    noise: float = 0.0
    keep: tuple[str, ...] = ("test",)
    size: float = 1.0


@dataclass(frozen=True)
class TrainingState:
    """What scenarios take over from training: label dictionary and scaler."""

    dictionary: DataFrame
    scaler: DataFrame
    method: str = "standard"


def scenarios(
    single: Sequence[str] = ("ES",),
    countries: Sequence[str] = ALL_COUNTRIES,
    histories: Sequence[int] = (3 * DAY, 7 * DAY, 10 * DAY),
    lead: int = 3 * DAY,
) -> list[Scenario]:
    """N1 one series, N2 all series, N3 all series with noise; A to C by growing history."""
    levels = {"N1": (single, 0.0), "N2": (countries, 0.0), "N3": (countries, NOISE_LEVEL)}
    return [
        Scenario(level + letter, tuple(names), max(histories), lead, seq_len, noise)
        for level, (names, noise) in levels.items()
        for letter, seq_len in zip("ABC", histories)
    ]


def training_scenario(countries: Sequence[str] = ALL_COUNTRIES, lag: int = 10 * DAY, lead: int = 3 * DAY) -> Scenario:
    return Scenario("treinamento", tuple(countries), lag, lead, lag, keep=("train", "val"))


def tuning_scenario(countries: Sequence[str] = ALL_COUNTRIES, lag: int = 10 * DAY, lead: int = 3 * DAY) -> Scenario:
    return Scenario("CV", tuple(countries), lag, lead, lag, keep=("train", "val"), size=0.2)


def select_rows(base: DataFrame, case: Scenario) -> DataFrame:
    """The scenario's series, and its share of their rows."""
    rows = filter_countries(base, case.countries)
    if 0.0 < case.size < 1.0:
        rows = sample_per_group(rows, case.size, ["country", "datetime"], ["country"], SEED)
    return rows


def fit_cuts(rows: DataFrame) -> SplitCuts:
    return fit_split(rows, *SHARES, order=("country",))


def fit_training_state(rows: DataFrame, cuts: SplitCuts, method: str = "standard") -> TrainingState:
    """Labels and scaler learned on training rows only."""
    train = split_rows(rows, cuts, ["train"]).withColumn("year", F.year("datetime"))
    dictionary = label_fit(train, ["country", "year"])
    scaler = fit_scaler(train, [VALUE])
    # Scenarios look the state up many times; a local copy saves fitting it anew each time.
    return TrainingState(local_if_bounded(dictionary) or dictionary, local_if_bounded(scaler) or scaler, method)


def with_noise(rows: DataFrame, level: float, seed: int = SEED) -> DataFrame:
    """``quantity_MW_noise``: the value plus noise of ``level`` sample deviations."""
    spread = column_std(rows, [VALUE]).first()[VALUE]
    seconds = F.unix_seconds("datetime").cast("string")
    part = F.unix_micros("datetime") % 1_000_000
    when = F.when(part == 0, seconds).otherwise(F.concat_ws(".", seconds, part.cast("string")))
    key = F.concat_ws("|", F.coalesce(F.col("country").cast("string"), F.lit("\\N")), F.coalesce(when, F.lit("\\N")))
    return rows.withColumn(VALUE + NOISE_SUFFIX, add_noise(F.col(VALUE), key, level * (spread or 0.0), seed))


def prepare(
    rows: DataFrame, case: Scenario, cuts: SplitCuts, state: TrainingState
) -> tuple[DataFrame, str]:
    """Encoded, split and scaled rows of the kept splits, and the name of the value column."""
    series = VALUE
    if case.noise:
        rows = with_noise(rows, case.noise)
        series = VALUE + NOISE_SUFFIX
    kept = split_rows(rows, cuts, case.keep)
    encoded = label_encode(time_cycle(kept), state.dictionary, ["country", "year"])
    scaled = scale_transform(encoded, state.scaler, [c for c in (VALUE, series) if c in encoded.columns], state.method)
    return scaled, series


def flat_features(lag: int) -> list[str]:
    """Feature order of the flat matrix, the same in training and in every scenario."""
    return [*BASE_FEATURES, *step_columns(VALUE, "lag", lag)]


def flat_dataset(
    rows: DataFrame, case: Scenario, cuts: SplitCuts, state: TrainingState, mask_value: float = 0.0
) -> DataFrame:
    """The scenario's flat matrix, windows inside each split."""
    prepared, series = prepare(rows, case, cuts, state)
    return flat_matrix(
        prepared, [series], [VALUE], case.lag, case.lead, case.seq_len, mask_value, groups=GROUPS
    )


def flat_xy(df: DataFrame, case: Scenario) -> DataFrame:
    """The flat matrix as ``X`` and ``Y`` arrays; columns are picked by name."""
    keyed = df.withColumn("_code", F.col("country"))
    packed = flat_arrays(keyed, flat_features(case.lag), step_columns(VALUE, "lead", case.lead))
    return packed.withColumnRenamed("_code", "country")


def sequence_dataset(rows: DataFrame, case: Scenario, cuts: SplitCuts, state: TrainingState) -> DataFrame:
    """The scenario's sequences of ``seq_len`` steps, windows inside each split."""
    prepared, series = prepare(rows, case, cuts, state)
    features = [series if c == VALUE else c for c in BASE_FEATURES]
    windows = sequence_windows(prepared, features, [VALUE], case.seq_len, case.lead, GROUPS)
    return window_country_id(windows)


def panel_dataset(rows: DataFrame, case: Scenario, cuts: SplitCuts) -> DataFrame:
    """The scenario's panel with clock parts; noise, if any, is in the value column's features."""
    if case.noise:
        rows = with_noise(rows, case.noise)
    kept = split_rows(rows, cuts, case.keep)
    return panel_frame(time_parts(kept), GROUPS).withColumn("_group_id", F.col("country"))


def level_windows(
    rows: DataFrame, cases: Sequence[Scenario], cuts: SplitCuts, state: TrainingState, mask_value: float = 0.0
) -> DataFrame:
    """``X``, ``Y`` and ``scenario`` for cases that differ in name and history only."""
    case = cases[0]
    prepared, series = prepare(rows, case, cuts, state)
    features = [series if c == VALUE else c for c in BASE_FEATURES]
    windows = flat_windows(
        prepared,
        features,
        [series],
        [VALUE],
        case.lag,
        case.lead,
        sorted({c.seq_len for c in cases}),
        mask_value,
        GROUPS,
    )
    names = F.array(*[F.struct(F.lit(c.name).alias("scenario"), F.lit(min(c.seq_len, c.lag)).alias("_h")) for c in cases])
    named = windows.select("*", F.inline(names)).where(F.col("_h") == F.col("seq_len"))
    return named.select("scenario", "split", "country", "datetime", "time_idx", "X", "Y")


def sequence_level(rows: DataFrame, cases: Sequence[Scenario], cuts: SplitCuts, state: TrainingState) -> DataFrame:
    """``X`` of each case's own length, ``Y``, ``country_id`` and ``scenario`` for cases that differ in name and history only.

    Noise, if the cases have any, is in ``X`` alone.
    """
    prepared, series = prepare(rows, cases[0], cuts, state)
    features = [series if c == VALUE else c for c in BASE_FEATURES]
    histories = sorted({c.seq_len for c in cases})
    windows = sequence_windows(prepared, features, [VALUE], max(histories), cases[0].lead, GROUPS, histories=histories)
    named = _named(window_country_id(windows), cases, "seq_len")
    return named.select("scenario", "split", "country", "country_id", "datetime", "time_idx", "X", "Y")


def panel_level(rows: DataFrame, cases: Sequence[Scenario], cuts: SplitCuts, state: TrainingState) -> DataFrame:
    """Encoder, decoder and static arrays, ``Y`` and ``scenario`` for cases that differ in name and history only.

    Noise, if the cases have any, is in ``encoder_target`` alone; what the decoder knows is clock and position.
    The static array holds the code of the series.
    """
    case = cases[0]
    noisy = VALUE + NOISE_SUFFIX if case.noise else None
    kept = split_rows(with_noise(rows, case.noise) if case.noise else rows, cuts, case.keep)
    framed = apply_codes(panel_frame(time_parts(kept), GROUPS), state.dictionary, "country", "series_code")
    histories = sorted({c.seq_len for c in cases})
    windows = panel_windows(framed, VALUE, max(histories), case.lead, groups=GROUPS, history=noisy, static=["series_code"], histories=histories)
    named = _named(windows.withColumnRenamed("decoder_target", "Y"), cases, "encoder_length")
    return named.select("scenario", "split", "country", "datetime", "time_idx", "Y", *PANEL_INPUTS)


def _named(windows: DataFrame, cases: Sequence[Scenario], length: str) -> DataFrame:
    """Windows once per case of their length, with its name."""
    names = F.array(*[F.struct(F.lit(c.name).alias("scenario"), F.lit(c.seq_len).alias("_h")) for c in cases])
    return windows.select("*", F.inline(names)).where(F.col("_h") == F.col(length))


def levels_of(base: DataFrame, cases: Sequence[Scenario]) -> Iterator[tuple[DataFrame, list[Scenario], SplitCuts]]:
    """Rows, members and cut points of each set of cases that differ in history only."""
    levels: dict[Scenario, list[Scenario]] = {}
    for case in cases:
        levels.setdefault(replace(case, name="", seq_len=case.lag), []).append(case)
    cuts: dict[tuple, SplitCuts] = {}
    for level, members in levels.items():
        rows = select_rows(base, level)
        key = (level.countries, level.size)
        if key not in cuts:
            cuts[key] = fit_cuts(rows)
        yield rows, members, cuts[key]


def run_scenarios(
    base: DataFrame, cases: Sequence[Scenario], state: TrainingState, predict: Predict, mask_value: float = 0.0
) -> DataFrame:
    """Metrics of every scenario in one lazy plan, with a ``scenario`` column.

    ``base`` should be a written table. Cases that differ in history only share their cut
    points, their preparation and one window pass; all forecasts are scored and measured
    together.
    """
    windows = [level_windows(rows, members, cuts, state, mask_value) for rows, members, cuts in levels_of(base, cases)]
    return evaluate(
        union_days(windows),
        predict,
        by=["scenario"],
        state=state.scaler,
        dictionary=state.dictionary,
        method=state.method,
    )


def run_sequence_scenarios(base: DataFrame, cases: Sequence[Scenario], state: TrainingState, predict: PredictInputs) -> DataFrame:
    """As ``run_scenarios``, for models of sequences: ``predict`` gets ``X`` (rows, steps, features) and ``country_id``
    (rows,), cases of different histories apart."""
    windows = [sequence_level(rows, members, cuts, state) for rows, members, cuts in levels_of(base, cases)]
    return evaluate(
        union_days(windows),
        predict,
        by=["scenario"],
        state=state.scaler,
        dictionary=state.dictionary,
        method=state.method,
        inputs={"X": len(BASE_FEATURES), "country_id": 0},
    )


def run_panel_scenarios(base: DataFrame, cases: Sequence[Scenario], state: TrainingState, predict: PredictInputs) -> DataFrame:
    """As ``run_scenarios``, for encoder-decoder models: ``predict`` gets the arrays of ``PANEL_INPUTS`` together. Values are in
    original units, as such models bring their own normalisation."""
    windows = [panel_level(rows, members, cuts, state) for rows, members, cuts in levels_of(base, cases)]
    return evaluate(union_days(windows), predict, by=["scenario"], inputs=PANEL_INPUTS)
