"""Number and time expressions."""
from pyspark.sql import functions as F

NAN = float("nan")


def share(part, whole):
    """part / whole, NULL where the whole is zero (ANSI division would raise)."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def nan_if_null(value):
    return F.coalesce(value, F.lit(NAN))


def hours_between(later, earlier):
    return (later - earlier) / 3600


def age_at_snapshot(snapshot, created):
    """Hours a post had been up when first seen; NaN for rows without a time stamp."""
    stamped = snapshot.isNotNull() & (snapshot != 0)
    return F.when(stamped, hours_between(snapshot, created)).otherwise(F.lit(NAN))


def month_of(epoch_seconds):
    """First day of the UTC month, independent of the session time zone."""
    return F.trunc(F.date_from_unix_date(F.floor(epoch_seconds / 86400).cast("int")), "month")


def flag_precision(precision, base_rate):
    caught = base_rate * precision
    wrong = (1 - base_rate) * (1 - precision)
    return F.coalesce(F.try_divide(caught, caught + wrong), F.lit(0.0))


def decide(confidence, threshold):
    return F.when(confidence >= threshold, "auto_resolve").otherwise("escalate_to_human")


def argmax_label(probabilities, classes):
    """Label of the first largest probability; `classes` is the sorted class array."""
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(classes, best)


def seeded_hash(key, seed):
    """Uniform, engine-independent sort key for seeded sampling."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_digits(hashed):
    """Two 16-bit digits of a hex digest, for ranking uniformly spread keys."""
    return [F.substring(hashed, 1, 4), F.substring(hashed, 5, 4)]


def time_digits(seconds):
    """Day and second within the day of an ascending number of seconds."""
    second = F.floor(seconds)
    return [F.floor(seconds / 86400), F.pmod(second, F.lit(86400))]


def double_digits(value):
    """Three digits that sort like the double they come from; infinities sort outermost.

    Binary exponent, then twice 12 bits of the mantissa: at most a few thousand values each however
    the data is spread, which keeps every window that ranks by them small.
    """
    infinite, sign = F.abs(value) == float("inf"), F.signum(value)
    size = F.when(infinite, F.lit(1.0)).otherwise(F.abs(value))
    exponent = F.floor(F.log2(size))
    mantissa = (size / F.pow(F.lit(2.0), exponent) - 1) * 4096
    high = F.floor(mantissa)
    low = F.floor((mantissa - high) * 4096)

    def signed(digit):
        return F.when(value == 0, F.lit(0)).otherwise((sign * digit).cast("long"))
    exponent = F.when(infinite, F.lit(5000)).otherwise(exponent)
    return [signed(exponent + 2000), signed(high), signed(low)]
