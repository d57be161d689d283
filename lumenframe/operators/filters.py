"""Filter strings to DataFrame transforms.

'scale=1280:720,fps=30;[a]hflip[b]' is chains divided by ';', each a list of
filters divided by ','. Quotes, backslashes and brackets guard separators. A
parsed chain is compiled to functions from DataFrame to DataFrame; Catalyst
plans the composition. At the end of a stream nothing is held back, so there is
no separate flush.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators.segments import drop_duplicate

Stage = Callable[[DataFrame], DataFrame]


def split_guarded(text: str, mark: str) -> list[str]:
    """Pieces between marks that no quote, backslash or bracket guards."""
    pieces, own, quote, depth, escaped = [], "", "", 0, False
    for c in text:
        if escaped:
            own, escaped = own + c, False
        elif c == "\\":
            own, escaped = own + c, True
        elif quote:
            own, quote = own + c, "" if c == quote else quote
        elif c in "'\"":
            own, quote = own + c, c
        elif c == mark and not depth:
            pieces.append(own)
            own = ""
        else:
            depth = max(0, depth + (c == "[") - (c == "]"))
            own += c
    return [*pieces, own]


def unquoted(text: str) -> str:
    """A value without its quotes and escapes."""
    out, quote, escaped = "", "", False
    for c in text.strip():
        if escaped:
            out, escaped = out + c, False
        elif c == "\\":
            escaped = True
        elif quote and c == quote:
            quote = ""
        elif not quote and c in "'\"":
            quote = c
        else:
            out += c
    return out


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple[str, ...] = ()
    named: dict[str, str] = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Filter:
        text, labels = text.strip(), ([], [])
        while text.startswith("["):
            label, _, text = text[1:].partition("]")
            labels[0].append(label)
        while text.endswith("]"):
            text, _, label = text[:-1].rpartition("[")
            labels[1].insert(0, label)
        name, _, rest = text.partition("=")
        if not name.strip():
            raise ValueError(f"no filter name in {text!r}")
        args, named = [], {}
        for part in split_guarded(rest, ":") if rest else []:
            key, mark, value = part.partition("=")
            if mark and key.strip().isidentifier():
                named[key.strip()] = unquoted(value)
            else:
                args.append(unquoted(part))
        return cls(name.strip(), tuple(args), named, tuple(labels[0]), tuple(labels[1]))

    def get(self, place: int, name: str, default: str | None = None) -> str:
        if name in self.named:
            return self.named[name]
        if place < len(self.args):
            return self.args[place]
        if default is None:
            raise ValueError(f"{self.name} needs {name}")
        return default


def parse_chain(text: str) -> list[Filter]:
    return [Filter.parse(part) for part in split_guarded(text, ",") if part.strip()]


def parse_graph(text: str) -> list[list[Filter]]:
    return [parse_chain(part) for part in split_guarded(text, ";") if part.strip()]


def _scale(f: Filter) -> Stage:
    """New width and height; -1 keeps the ratio, on even numbers."""
    w, h = int(f.get(0, "w")), int(f.get(1, "h", "-1"))
    even = lambda c: (F.round(c / 2) * 2).cast("int")
    width = F.lit(w) if w > 0 else even(F.col("width") * h / F.col("height"))
    height = F.lit(h) if h > 0 else even(F.col("height") * w / F.col("width"))
    return lambda df: df.withColumns({"width": width, "height": height})


def _crop(f: Filter) -> Stage:
    w, h = int(f.get(0, "w")), int(f.get(1, "h"))
    return lambda df: df.withColumns({"width": F.least("width", F.lit(w)), "height": F.least("height", F.lit(h))})


def _pad(f: Filter) -> Stage:
    w, h = int(f.get(0, "w")), int(f.get(1, "h"))
    return lambda df: df.withColumns({"width": F.greatest("width", F.lit(w)), "height": F.greatest("height", F.lit(h))})


def _fps(f: Filter) -> Stage:
    """Copies or drops rows of each stream to the new rate; needs columns stream, frame and fps."""
    rate = float(f.get(0, "fps", "25"))

    def stage(df: DataFrame) -> DataFrame:
        ratio = F.lit(rate) / F.col("fps")
        k = F.col("frame") + 1
        copies = (F.floor(k * ratio) - F.floor((k - 1) * ratio)).cast("int")
        return df.withColumn("__n", copies).where(F.col("__n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("fps", F.lit(rate)).drop("__n")

    return stage


def _eq(f: Filter) -> Stage:
    brightness, contrast = float(f.get(0, "brightness", "0")), float(f.get(1, "contrast", "1"))
    return lambda df: df.withColumn("data", F.transform("data", lambda x: F.least(F.greatest((x - 128) * contrast + 128 + brightness * 255, F.lit(0.0)), F.lit(255.0))))


def _volume(f: Filter) -> Stage:
    text = f.get(0, "volume", "1")
    db = float(text[:-2]) if text.lower().endswith("db") else None
    factor = 10 ** (db / 20) if db is not None else float(text)
    return lambda df: df.withColumn("samples", F.transform("samples", lambda x: x * factor))


def _setpts(f: Filter) -> Stage:
    tempo = float(f.get(0, "tempo", "1"))
    return lambda df: df.withColumn("ts", F.col("ts") / tempo)


def _format(f: Filter) -> Stage:
    return lambda df: df.withColumn("format", F.lit(f.get(0, "pix_fmts")))


def _transpose(f: Filter) -> Stage:
    return lambda df: df.withColumns({"width": F.col("height"), "height": F.col("width")})


def _flip(kernel) -> Callable[[Filter], Stage]:
    def build(f: Filter) -> Stage:
        width = int(f.get(0, "width"))
        return lambda df: df.withColumn("data", kernel(F.col("data"), width))

    return build


def _noise(f: Filter) -> Stage:
    """Seeded noise by row; the same rows get the same noise."""
    seed, strength = int(f.get(0, "seed", "0")), float(f.get(1, "strength", "1"))
    draw = (F.pmod(F.xxhash64("frame", F.lit(seed)), F.lit(2001)) - 1000) / 1000
    return lambda df: df.withColumn("data", F.transform("data", lambda x: F.least(F.greatest(x + draw * strength, F.lit(0.0)), F.lit(255.0))))


#: The operators that filter strings may name.
REGISTRY: dict[str, Callable[[Filter], Stage]] = {
    "scale": _scale, "crop": _crop, "pad": _pad, "fps": _fps, "eq": _eq, "volume": _volume, "atempo": _setpts,
    "format": _format, "aformat": _format, "transpose": _transpose, "hflip": _flip(arrays.flip_rows), "vflip": _flip(arrays.flip_columns), "noise": _noise,
}


def register(name: str, build: Callable[[Filter], Stage]) -> None:
    """Adds an operator; a name that is taken is an error."""
    if name in REGISTRY:
        raise ValueError(f"filter {name} exists")
    REGISTRY[name] = build


def compile_chain(chain: list[Filter]) -> Stage:
    unknown = [f.name for f in chain if f.name not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown filters {unknown}")
    stages = [REGISTRY[f.name](f) for f in chain]
    return lambda df: reduce(lambda d, s: d.transform(s), stages, df)


def apply(df: DataFrame, text: str) -> DataFrame:
    """df through a chain of filters."""
    return compile_chain(parse_chain(text))(df)


def run_graph(sources: dict[str, DataFrame], text: str) -> dict[str, DataFrame]:
    """Named frames through a graph: each chain reads its input labels and writes its output label.

    A chain of two inputs begins with overlay, which joins them on frame.
    """
    named = dict(sources)
    for chain in parse_graph(text):
        inputs = [named[label] for label in chain[0].inputs] or [next(iter(sources.values()))]
        rest = list(chain)
        if rest[0].name == "overlay":
            frame = overlay(*inputs, float(rest.pop(0).get(0, "alpha", "0.5")))
        else:
            frame = inputs[0]
        named[(chain[-1].outputs or ("out",))[0]] = compile_chain(rest)(frame)
    return named


def overlay(base: DataFrame, top: DataFrame, alpha: float) -> DataFrame:
    """Rows of both by frame, the pixels blended."""
    other = top.select("frame", F.col("data").alias("__top"))
    return base.join(other, "frame").withColumn("data", arrays.blend(F.col("data"), F.col("__top"), alpha)).drop("__top")


def supported_share(chain: list[Filter]) -> float:
    """Share of filters that are known; 1 for none."""
    return sum(f.name in REGISTRY for f in chain) / len(chain) if chain else 1.0


def supported_share_of(text: Column) -> Column:
    """supported_share of a column of filter texts; commas in quotes or brackets don't part filters."""
    names = F.regexp_extract_all(F.regexp_replace(text, r"\\.|'[^']*'|\[[^\]]*\]|\([^)]*\)", ""), F.lit(r"(?:^|[,;])\s*([A-Za-z_0-9]+)"), F.lit(1))
    known = F.filter(names, lambda n: n.isin(*REGISTRY))
    return F.when(F.size(names) > 0, F.size(known) / F.size(names)).otherwise(1.0)


def rate_converted(df: DataFrame, source: float, target: float) -> DataFrame:
    return drop_duplicate(df, ["stream"], ["frame"], target / source)
