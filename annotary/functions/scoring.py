"""Class-score arithmetic on one row's array of logits or probabilities.

With ``n_classes`` known the arithmetic is written out per class, which keeps
it inside generated code; without, it falls back to array functions.
"""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from annotary.functions.geometry import let


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def _items(scores, n_classes):
    scores = _col(scores)
    return [F.get(scores, c).cast("double") for c in range(n_classes)]


def _largest(items):
    return F.greatest(*items) if len(items) > 1 else items[0]


def softmax(logits, n_classes=None) -> Column:
    if n_classes is not None:
        items = _items(logits, n_classes)
        top = _largest(items)
        exps = [F.exp(v - top) for v in items]
        total = reduce(add, exps)
        return F.array(*[e / total for e in exps])
    # Inside an array function an expression is evaluated for every element, so
    # what all elements need is computed first.
    def scaled(s):
        return F.transform(s["values"], lambda v: F.exp(v - s["top"]))

    def shares(exps):
        total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
        both = F.struct(exps.alias("exps"), total.alias("total"))
        return let(both, lambda b: F.transform(b["exps"], lambda v: v / b["total"]))

    values = F.transform(_col(logits), lambda v: v.cast("double"))
    both = let(values, lambda v: F.struct(v.alias("values"), F.array_max(v).alias("top")))
    return let(let(both, scaled), shares)


def argmax(scores) -> Column:
    """Index of the largest score; the first one wins a tie."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confidence(probs) -> Column:
    return F.array_max(_col(probs))


def squared_error(probs, target, n_classes=None) -> Column:
    """Multiclass Brier term: sum over classes of (p - 1[class = target])^2."""
    target = _col(target)

    def term(p, c):
        off = p - F.when(target == c, 1.0).otherwise(0.0)
        return off * off

    if n_classes is not None:
        return reduce(add, [term(p, c) for c, p in enumerate(_items(probs, n_classes))])
    return F.aggregate(F.transform(_col(probs), term), F.lit(0.0), lambda acc, v: acc + v)


#: The smallest normal double; a probability below it counts as that much in a loss.
LEAST_PROBABILITY = 2.2250738585072014e-308


def cross_entropy(probs, target) -> Column:
    """From probabilities alone: at most 708.4, for probabilities that underflow to 0."""
    return -F.ln(F.greatest(F.get(_col(probs), _col(target)), F.lit(LEAST_PROBABILITY)))


def logit_cross_entropy(logits, target, n_classes) -> Column:
    """Negative log-softmax of the target, exact however small its probability."""
    items = _items(logits, n_classes)
    top = _largest(items)
    total = reduce(add, [F.exp(v - top) for v in items])
    return F.ln(total) + top - F.get(_col(logits), _col(target)).cast("double")


def confidence_bin(conf, n_bins) -> Column:
    """Equal-width bin of a confidence; 1.0 falls in the last bin."""
    return F.least(F.floor(_col(conf) * n_bins), F.lit(n_bins - 1)).cast("int")
