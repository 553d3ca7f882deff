"""Loudness: measurements from logs, gain plans against a true-peak ceiling, selection, counts and work orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import whole_number
from ..functions.paths import media_class

#: Ceilings in dBTP, the bitrate from which the higher one holds, the least headroom and the step of native gain (fixed values).
DEFAULT_TARGET, LOW_TARGET, HIGH_KBPS, LEAST_HEADROOM, STEP_DB = -0.5, -1.0, 256, 0.05, 1.5
METHODS = ("FfmpegLossless", "Mp3Lossless", "AacLossless", "Mp3Reencode", "AacReencode")
DEFAULT_KBPS = {"Mp3": 320, "Aac": 256}
ENCODERS = {"Mp3": ("libmp3lame",), "Aac": ("libfdk_aac", "aac")}


def is_lossy(kind: Column) -> Column:
    """Of a media class. What is neither MP3 nor AAC counts as lossless, files of an unknown kind too."""
    return F.coalesce(kind.isin("mp3", "aac"), F.lit(False))


@dataclass(frozen=True)
class TpTarget:
    """One ceiling for all files, or a higher one for lossless and high-bitrate files and a lower one for the rest."""

    high: float = DEFAULT_TARGET
    low: float | None = None

    @classmethod
    def uniform(cls, target: float) -> TpTarget:
        return cls(target)

    @classmethod
    def split(cls, high: float = DEFAULT_TARGET, low: float = LOW_TARGET) -> TpTarget:
        return cls(high, low)

    @classmethod
    def chosen(cls, target: float | None = None, split: bool = False) -> TpTarget:
        """An explicit ceiling first, then the split one, else the default; not both."""
        if target is not None and split:
            raise ValueError("give a target or split, not both")
        return cls.uniform(target) if target is not None else cls.split() if split else cls()

    def column(self, kind: Column, kbps: Column) -> Column:
        if self.low is None:
            return F.lit(float(self.high))
        return F.when(~is_lossy(kind) | (kbps >= HIGH_KBPS), F.lit(float(self.high))).otherwise(F.lit(float(self.low)))


#: What stands before a measurement in a log (fixed value).
MARKER = "[Parsed_loudnorm_0 @"
_NUMBER = r"(?i)\A[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


def _closed(text: Column) -> Column:
    """Whether the brace that text begins with is closed: somewhere as many closing ones have come as opening ones."""
    parts = F.split(text, r"\}")
    step = lambda a, x: F.struct((a["depth"] + F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))) - 1).alias("depth"), (a["done"] | (a["depth"] + F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))) <= 1)).alias("done"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done")), step)["done"]


def _object(text: Column) -> Column:
    """The JSON object that text begins with: input_i, input_tp (variants) and broken (null unless it is no object). What follows it isn't read."""
    return F.from_json(text, "input_i variant, input_tp variant, broken string", {"columnNameOfCorruptRecord": "broken"})


def parse_logs(logs: DataFrame, log: str = "log") -> DataFrame:
    """logs with input_i, input_tp (double, null without a measurement) and log_kbps, in place of the log.

    The measurement is the object after the first marker; without a marker, or without a whole object after it, the object that
    opens last before the last "input_i". Its two values must be JSON strings of numbers. A marker with a broken object gives none.
    The bitrate is that of the first line which begins with Duration:, if it is a whole number.
    """
    own = [c for c in logs.columns if c != log]
    text = F.col("w_log")
    t = logs.select(*own, F.col(log).alias("w_log"), F.instr(F.col(log), MARKER).alias("w_at"))
    t = t.withColumn("w_open", F.when(F.col("w_at") > 0, F.expr("locate('{', w_log, w_at)")).otherwise(0))
    t = t.withColumn("w_first", F.when(F.col("w_open") > 0, _object(F.expr("substring(w_log, w_open)"))))
    whole = F.coalesce(F.col("w_first").isNotNull() & (F.col("w_first.broken").isNull() | _closed(F.expr("substring(w_log, w_open)"))), F.lit(False))
    tail = F.substring_index(text, '"input_i"', -1)
    head = F.left(text, F.length(text) - F.length(tail) - len('"input_i"'))
    last = F.when(F.contains(text, F.lit('"input_i"')) & F.contains(head, F.lit("{")), F.concat(F.lit("{"), F.substring_index(head, "{", -1), F.lit('"input_i"'), tail))
    t = t.withColumn("w_found", F.when(whole, F.col("w_first")).otherwise(_object(last)))

    def number(name: str) -> Column:
        value = F.try_variant_get(F.col(f"w_found.{name}"), "$", "string")
        return F.when(value.rlike(_NUMBER), value.try_cast("double"))

    line = F.regexp_extract(text, r"(?md)^[^\S\n]*Duration:(.*)$", 1)
    kbps = F.regexp_extract(line, r"bitrate:\s*\+?([0-9]+)(?:\s|\z)", 1).try_cast("int")
    both = (F.schema_of_variant("w_found.input_i") == "STRING") & (F.schema_of_variant("w_found.input_tp") == "STRING")
    # One row a log through a generator: later filters on the results can't be pushed below it, where they would parse again.
    return t.select(*own, F.inline(F.array(F.struct(*[F.when(both, number(k)).alias(k) for k in ("input_i", "input_tp")], kbps.alias("log_kbps")))))


def rejects(measured: DataFrame) -> DataFrame:
    """Rows that can't be planned, with the reason: no measurement, or one that isn't finite (a silent file)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    reason = F.when(F.col("input_i").isNull() | F.col("input_tp").isNull(), "no_measurement").when(~finite("input_i") | ~finite("input_tp"), "not_finite")
    return measured.withColumn("reason", reason).where("reason IS NOT NULL")


def accepted(measured: DataFrame) -> DataFrame:
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    return measured.where(finite("input_i") & finite("input_tp"))


def with_bitrate(measured: DataFrame, probes: DataFrame, on: list[str], ext: str = "ext") -> DataFrame:
    """kbps of lossy files: the log's, else the probe's (bits per second, whole thousands). Lossless files have none."""
    probed = probes.select(*on, whole_number(F.col("format_bit_rate")).alias("bps"))
    kbps = F.when(is_lossy(media_class(F.col(ext))), F.coalesce("log_kbps", F.expr("CAST(bps DIV 1000 AS INT)")))
    return measured.join(probed, on, "left").withColumn("kbps", kbps).drop("bps")


def gain_plan(measured: DataFrame, target: TpTarget = TpTarget(), ext: str = "ext", kbps: str = "kbps") -> DataFrame:  # noqa: B008
    """measured with target_tp, headroom, gain_method, effective_gain and lossless_gain_steps."""
    return _planned(measured, target.column(media_class(F.col(ext)), F.col(kbps)), ext)


def _planned(measured: DataFrame, ceiling: Column, ext: str) -> DataFrame:
    kind = media_class(F.col(ext))
    steps = F.floor(F.col("headroom") / STEP_DB)
    name = F.when(kind == "aac", "Aac").otherwise("Mp3")
    method = F.when(F.col("headroom") < LEAST_HEADROOM, "None").when(~is_lossy(kind), "FfmpegLossless").when(steps >= 1, F.concat(name, F.lit("Lossless"))).otherwise(F.concat(name, F.lit("Reencode")))
    native = F.col("gain_method").isin("Mp3Lossless", "AacLossless")
    return (
        measured.withColumn("target_tp", ceiling)
        .withColumn("headroom", F.col("target_tp") - F.col("input_tp"))
        .withColumn("gain_method", method)
        .withColumn("effective_gain", F.when(F.col("gain_method") == "None", F.lit(0.0)).when(native, steps * STEP_DB).otherwise(F.col("headroom")))
        .withColumn("lossless_gain_steps", F.when(native, steps.cast("int")).otherwise(0))
    )


def requires_reencode(method: Column) -> Column:
    return method.isin("Mp3Reencode", "AacReencode")


def select_files(plan: DataFrame, lossless: bool = True, reencode: bool = False) -> DataFrame:
    """Files with headroom, by two switches."""
    method = F.col("gain_method")
    return plan.where((method != "None") & F.when(requires_reencode(method), F.lit(reencode)).otherwise(F.lit(lossless)))


def _method_counts() -> list[Column]:
    """The summary's columns as aggregates of a plan."""
    count = lambda methods: F.count_if(F.col("gain_method").isin(*methods))
    lossless, again = METHODS[:3], METHODS[3:]
    return [*(count([m]).alias(m) for m in METHODS), count(lossless).alias("total_lossless"), count(again).alias("total_reencode"), (count(METHODS) > 0).alias("has_processable")]


def method_summary(plan: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Counts by method, their totals, and whether there is anything to do."""
    return plan.groupBy(*by).agg(*_method_counts())


def observed(plan: DataFrame, name: str = "gain_summary") -> tuple[DataFrame, Observation]:
    """The plan, and an Observation of its method counts over all rows (as of method_summary): they come with the job that writes the plan,
    without a second scan. Rows that fail (a null method) are counted as failures."""
    seen = Observation(name)
    return plan.observe(seen, *_method_counts(), F.count_if(F.col("gain_method").isNull()).alias("failures")), seen


def observed_actions(acted: DataFrame, name: str = "action_summary") -> tuple[DataFrame, Observation]:
    """A conversion's rows, and an Observation of how many have each action, and how many none (failures)."""
    seen = Observation(name)
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ("Copy", "ReencodeLossy", "Reencode")]
    return acted.observe(seen, *counts, F.count_if(F.col("action").isNull()).alias("failures")), seen


SETTINGS = "target double, split boolean, lossless boolean, no_lossless boolean, reencode boolean, no_reencode boolean"


def resolved_settings(settings: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Settings as rows, one for each library, to what they mean: high, low (null for one ceiling), lossless, reencode and status.

    settings has by and the columns of SETTINGS, nulls for what isn't set. An explicit target comes first, then the split ceiling, else
    the default; native gain is on unless switched off, re-encoding off unless switched on. status: ok, target_and_split,
    lossless_conflict, reencode_conflict, or repeated (a library with several rows; it is given once); others have no meaning, and nulls there.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = settings.groupBy(*by).agg(F.count("*").alias("w_n"), *[F.first(c).alias(c) for c in ("target", "split", "lossless", "no_lossless", "reencode", "no_reencode")])
    status = (
        F.when(F.col("w_n") > 1, "repeated").when(F.col("target").isNotNull() & given("split"), "target_and_split").when(given("lossless") & given("no_lossless"), "lossless_conflict")
        .when(given("reencode") & given("no_reencode"), "reencode_conflict").otherwise("ok")
    )
    ok = lambda c: F.when(F.col("status") == "ok", c)
    high = F.when(F.col("target").isNotNull(), F.col("target")).otherwise(F.lit(DEFAULT_TARGET))
    return one.withColumn("status", status).select(
        *by, ok(high).alias("high"), ok(F.when(F.col("target").isNull() & given("split"), F.lit(LOW_TARGET))).alias("low"), ok(~given("no_lossless")).alias("lossless"), ok(given("reencode")).alias("reencode"), "status",
    )


def gain_plan_by_settings(measured: DataFrame, settings: DataFrame, by: tuple[str, ...] = ("collection_id",), ext: str = "ext", kbps: str = "kbps") -> DataFrame:
    """gain_plan under each library's own settings (SETTINGS), with selected (as of select_files) and settings_status.

    A library without a row has the defaults. One whose settings conflict isn't planned: its rows have the status and nulls.
    """
    own = resolved_settings(settings, by).select(*by, *[F.col(c).alias(f"w_{c}") for c in ("high", "low", "lossless", "reencode", "status")])
    joined = measured.join(own, list(by), "left").withColumn("settings_status", F.coalesce("w_status", F.lit("ok")))
    kind = media_class(F.col(ext))
    low = F.col("w_low").isNotNull() & is_lossy(kind) & ~F.coalesce(F.col(kbps) >= HIGH_KBPS, F.lit(False))
    ceiling = F.when(F.col("settings_status") == "ok", F.when(low, F.col("w_low")).otherwise(F.coalesce("w_high", F.lit(DEFAULT_TARGET))))
    plan = _planned(joined, ceiling, ext)
    again, planned = requires_reencode(F.col("gain_method")), F.col("target_tp").isNotNull()
    chosen = (F.col("gain_method") != "None") & F.when(again, F.coalesce("w_reencode", F.lit(False))).otherwise(F.coalesce("w_lossless", F.lit(True)))
    void = {c: F.when(planned, F.col(c)) for c in ("gain_method", "effective_gain", "lossless_gain_steps")}
    return plan.withColumn("selected", F.when(planned, chosen)).withColumns(void).drop("w_high", "w_low", "w_lossless", "w_reencode", "w_status")


def work_order(plan: DataFrame, ext: str = "ext", kbps: str = "kbps") -> DataFrame:
    """What to run for each file with headroom: tool, amount in dB or steps, and the output's settings."""
    method, low = F.col("gain_method"), F.lower(F.col(ext))
    coded = F.when(method.startswith("Mp3"), "Mp3").otherwise("Aac")
    again = requires_reencode(method)
    codec = F.when(method == "FfmpegLossless", F.when(low == "flac", "flac").when(low.isin("aiff", "aif"), "pcm_s24be").when(low == "wav", "pcm_s24le"))
    default = F.when(coded == "Mp3", DEFAULT_KBPS["Mp3"]).otherwise(DEFAULT_KBPS["Aac"])
    encoders = F.when(coded == "Mp3", F.array(*map(F.lit, ENCODERS["Mp3"]))).otherwise(F.array(*map(F.lit, ENCODERS["Aac"])))
    return plan.where(method != "None").select(
        "*",
        F.when(method == "FfmpegLossless", "ffmpeg").when(again, "reencode").otherwise("native").alias("tool"),
        F.when(method.isin("Mp3Lossless", "AacLossless"), F.lit(None).cast("double")).otherwise(F.col("effective_gain")).alias("gain_db"),
        F.when(method.isin("Mp3Lossless", "AacLossless"), F.col("lossless_gain_steps")).alias("gain_steps"),
        codec.alias("codec"),
        F.when(again, F.coalesce(F.col(kbps), default)).alias("encode_kbps"),
        F.when(again, F.array_join(encoders, ",")).alias("encoders"),
    )
