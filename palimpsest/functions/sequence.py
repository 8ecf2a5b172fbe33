"""Sequences of class ids and probabilities to text and confidence, and text to ids, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How a decoder numbers symbols and reads a sequence: specials before and after the charset, what ends it, what is left out (`skip`) or
    only not written (`hide`), which mean makes the confidence."""

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    collapse: bool = False
    stop: str | None = None
    stop_counts: bool = False
    skip: tuple[str, ...] = ()
    hide: tuple[str, ...] = ()
    confidence: str = "mean"
    reverse: bool = False
    shift: int = 0
    lead: str | None = None
    drop_first: bool = False
    first_only: bool = False

    def symbols(self, charset: list[str]) -> list[str]:
        return [*self.before, *charset, *self.after]

    def id_of(self, charset: list[str], symbol: str) -> int:
        return self.symbols(charset).index(symbol)


# The special symbols of each family of models and their places.
LAYOUTS = {
    "ctc": Layout(before=("blank",), collapse=True, skip=("blank",)),
    "ctc_label": Layout(before=("blank",), skip=("blank",)),
    "ar": Layout(before=("</s>",), after=("<s>", "<pad>"), stop="</s>", skip=("<s>", "<pad>")),
    "ce": Layout(first_only=True),
    "char": Layout(before=("blank", "<unk>", "<s>", "</s>"), stop="</s>", lead="<s>"),
    "cppd": Layout(before=("</s>",), stop="</s>"),
    "nrtr": Layout(before=("blank", "<unk>", "<s>", "</s>"), stop="</s>", lead="<s>"),
    "abinet": Layout(before=("</s>",), stop="</s>"),
    "visionlan": Layout(shift=1, confidence="geometric"),
    "lister": Layout(before=("</s>",), after=("<pad>",), stop="</s>", skip=("<pad>",)),
    "smtr": Layout(before=("</s>",), after=("<s>", "<INF>", "<INB>", "<pad>"), stop="</s>", skip=("<s>", "<pad>")),
    "smtr_back": Layout(before=("</s>",), after=("<s>", "<INF>", "<INB>", "<pad>"), stop="</s>", skip=("<s>", "<pad>"), reverse=True),
    "srn": Layout(after=("<BOS>", "<EOS>"), skip=("<BOS>", "<EOS>")),
    "igtr": Layout(before=("</s>",), after=("<s>", "<pad>"), stop="</s>", skip=("<s>", "<pad>")),
    "mgp": Layout(before=("[GO]", "[s]"), stop="[s]", stop_counts=True, hide=("[GO]",), drop_first=True, confidence="product"),
    "pg": Layout(after=("blank",), collapse=True, skip=("blank",)),
    "dptr": Layout(before=("[E]",), after=("[B]", "[P]"), stop="[E]", stop_counts=True),
}


def best_class(row: Column) -> Column:
    """Index of the greatest probability; the first of equals."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def steps(probs: Column) -> Column:
    """array<array<float>> -> array<struct<id, p>>: the best class of each step."""
    return F.transform(probs, lambda row: F.struct(best_class(row).alias("id"), F.array_max(row).cast("double").alias("p")))


def collapsed(path: Column) -> Column:
    """Steps whose class differs from that of the step before."""
    return F.filter(path, lambda s, i: (i == 0) | (s["id"] != F.get(path, i - 1)["id"]))


def confidence(ps: Column, kind: str) -> Column:
    n = F.size(ps)
    if kind == "product":
        return F.aggregate(ps, F.lit(1.0), lambda a, p: a * p)
    if kind == "geometric":
        return F.exp(F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.ln(p)) / (n + F.lit(1e-6)))
    return F.when(n > 0, F.aggregate(ps, F.lit(0.0), lambda a, p: a + p) / n).otherwise(0.0)


def decoded(path: Column, charset: list[str], layout: Layout) -> Column:
    """array<struct<id, p>> -> struct<text, conf>. Steps with ids out of the symbols are left out; no symbols: empty text."""
    names = layout.symbols(charset)
    ids = {s: i for i, s in enumerate(names)}
    if layout.collapse:
        path = collapsed(path)
    if layout.shift:  # id 0 is no symbol, and all steps count
        kept, scored = F.transform(F.filter(path, lambda s: s["id"] > 0), lambda s: F.struct((s["id"] - layout.shift).alias("id"), s["p"].alias("p"))), path
    else:
        kept = scored = _read(path, ids, layout)
        if layout.stop is not None:
            at = F.array_position(F.transform(kept, lambda s: s["id"]), ids[layout.stop]).cast("int")
            if layout.stop_counts:
                scored = F.when(at > 0, F.slice(kept, F.lit(1), at)).otherwise(kept)
            kept = F.when(at > 0, F.slice(kept, 1, F.greatest(at - 1, F.lit(0)))).otherwise(kept)
            scored = scored if layout.stop_counts else kept
    skip, unseen = [ids[s] for s in layout.skip], [ids[s] for s in (*layout.skip, *layout.hide)]
    if skip:
        scored = F.filter(scored, lambda s: ~s["id"].isin(skip))
    if unseen:
        kept = F.filter(kept, lambda s: ~s["id"].isin(unseen))
    table = F.array(*[F.lit(s) for s in names])
    chars = F.filter(F.transform(kept, lambda s: F.get(table, s["id"])), lambda c: c.isNotNull())
    text = F.array_join(F.reverse(chars) if layout.reverse else chars, "")
    return F.struct(text.alias("text"), confidence(F.transform(scored, lambda s: s["p"]), layout.confidence).alias("conf"))


def _read(path: Column, ids: dict[str, int], layout: Layout) -> Column:
    """The steps that a decoder looks at: from where it begins, those of its symbols."""
    rest = F.slice(path, 2, F.greatest(F.size(path), F.lit(1)))
    if layout.lead is not None:
        path = F.when(F.get(path, F.lit(0))["id"] == ids[layout.lead], rest).otherwise(path)
    if layout.drop_first:
        path = rest
    if layout.first_only:
        path = F.slice(path, 1, 1)
    return F.filter(path, lambda s: s["id"] < len(ids))


def decoded_with_boxes(path: Column, box_path: Column, charset: list[str]) -> Column:
    """Two heads of the `char` layout -> struct<text, conf, box_text, box_conf>.

    The second head has no specials, so its classes come after them; it is read step by step with the first, also where that begins
    with a start symbol that is left out, and up to the first's end symbol. A step with an id out of the symbols in either is left out.
    """
    layout = LAYOUTS["char"]
    names = layout.symbols(charset)
    rest = F.slice(path, 2, F.greatest(F.size(path), F.lit(1)))
    path = F.when(F.get(path, F.lit(0))["id"] == names.index(layout.lead), rest).otherwise(path)
    both = F.transform(path, lambda s, i: F.struct(s["id"].alias("id"), s["p"].alias("p"), (F.get(box_path, i)["id"] + len(layout.before)).alias("box"), F.get(box_path, i)["p"].alias("q")))
    both = F.filter(both, lambda s: (s["id"] < len(names)) & (s["box"] < len(names)))
    at = F.array_position(F.transform(both, lambda s: s["id"]), names.index(layout.stop)).cast("int")
    both = F.when(at > 0, F.slice(both, 1, F.greatest(at - 1, F.lit(0)))).otherwise(both)
    table = F.array(*[F.lit(s) for s in names])
    said = lambda k: F.array_join(F.transform(both, lambda s: F.get(table, s[k])), "")
    mean = lambda k: confidence(F.transform(both, lambda s: s[k]), "mean")
    return F.struct(said("id").alias("text"), mean("p").alias("conf"), said("box").alias("box_text"), mean("q").alias("box_conf"))


def decoded_guided(gtc_path: Column, ctc_path: Column, charset: list[str], gtc: str = "ar", only_gtc: bool = False) -> Column:
    """The two heads of a model whose training was guided by attention -> struct<gtc struct, ctc struct>, or that of the guide alone."""
    guide = decoded(gtc_path, charset, LAYOUTS[gtc])
    return guide if only_gtc else F.struct(guide.alias("gtc"), decoded(ctc_path, charset, LAYOUTS["ctc"]).alias("ctc"))


def top_classes(row: Column, k: int = 5) -> Column:
    """The k most probable classes of a step, least first."""
    pairs = F.transform(row, lambda p, i: F.struct(p.alias("p"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), -k, k), lambda s: s["id"])


def runs(path: Column) -> Column:
    """Runs of one class: array<struct<id, mid>> with the place start + length div 2."""
    marks = F.filter(F.transform(path, lambda s, i: F.struct(s["id"].alias("id"), i.alias("i"))), lambda s: (s["i"] == 0) | (s["id"] != F.get(path, s["i"] - 1)["id"]))
    ends = F.concat(F.slice(F.transform(marks, lambda s: s["i"]), 2, F.greatest(F.size(marks), F.lit(1))), F.array(F.size(path)))
    mids = F.zip_with(marks, ends, lambda s, e: F.struct(s["id"].alias("id"), (s["i"] + F.floor((e - s["i"]) / 2)).cast("int").alias("mid")))
    return F.when(F.size(path) > 0, mids).otherwise(F.expr("cast(array() as array<struct<id:int,mid:int>>)"))


def spread_points(points: Column, n: int) -> Column:
    """n points of a path of n or more: the first, those at equal steps, the last."""
    step = F.floor(F.size(points) / (n - 1)).cast("int")
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.get(points, i * step))
    return F.when(F.size(points) >= n, F.concat(inner, F.slice(points, -1, 1)))


def dense_points(points: Column) -> Column:
    """array<struct<y, x>> of whole points -> the same with those between each two, one for each step of the longer side, truncated."""

    def between(p: Column, i: Column) -> Column:
        q = F.get(points, i + 1)
        m = F.greatest(F.abs(p["y"] - q["y"]), F.abs(p["x"] - q["x"])).cast("int")
        on = lambda k, a: F.when(m > 0, p[a] - k * ((p[a] - q[a]).cast("double") / m)).otherwise(p[a]).cast("int")
        return F.when(q.isNull(), F.array(F.struct(p["y"].cast("int").alias("y"), p["x"].cast("int").alias("x")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), lambda k: F.struct(on(k, "y").alias("y"), on(k, "x").alias("x")))
        )

    return F.flatten(F.transform(points, between))


def read_along(probs: Column, paths: Column, charset: list[str], n: int = 6, dense: bool = False, least: int = 2) -> Column:
    """Texts along paths over a map of class probabilities (rows of columns of classes, the last class blank): array<struct<text, points>>.

    A path of fewer than `n` points, or a text of fewer than `least` characters, is left out. With `dense`, the points between a path's are
    read too. The points that are kept are `n` spread along what was read.
    """

    def read(path: Column) -> Column:
        path = dense_points(path) if dense else path
        found = steps(F.transform(path, lambda p: F.get(F.get(probs, p["y"].cast("int")), p["x"].cast("int"))))
        return F.struct(decoded(found, charset, LAYOUTS["pg"])["text"].alias("text"), spread_points(path, n).alias("points"))

    return F.filter(F.transform(F.filter(paths, lambda p: F.size(p) >= n), read), lambda r: F.length(r["text"]) >= least)


def best_head(heads: dict[str, Column]) -> Column:
    """Of struct<text, conf> heads the one with the greatest confidence; the earlier of equals."""
    top = F.greatest(*[h["conf"] for h in heads.values()]) if len(heads) > 1 else next(iter(heads.values()))["conf"]
    out = None
    for name, h in heads.items():
        pick = F.struct(F.lit(name).alias("head"), h["text"].alias("text"), h["conf"].alias("conf"))
        out = F.when(h["conf"] == top, pick) if out is None else out.when(h["conf"] == top, pick)
    return out


def known_ids(text: Column, charset: list[str], offset: int = 0, lower: bool = False) -> Column:
    """Ids (place in charset plus offset) of the characters of a text; others are left out."""
    table = F.array(*[F.lit(c) for c in charset])
    chars = F.filter(F.split(F.lower(text) if lower else text, ""), lambda c: c != "")
    at = F.transform(chars, lambda c: F.array_position(table, c).cast("int"))
    return F.transform(F.filter(at, lambda i: i > 0), lambda i: i - 1 + offset)


def _padded(ids: Column, size: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(ids))))


def encoded(text: Column, charset: list[str], kind: str, most: int = 25, lower: bool = False) -> Column:
    """A label for one kind of model: array<int>, null if the text has no known character or more than `most`.

    For `ce` the length limit counts all characters, for the others the known ones. Kinds and layouts are those of LAYOUTS; `ep`
    closes with its end symbol, `char` pads with zero; `char_head` is the label of that layout's second head.
    """
    layout = LAYOUTS[{"ep": "ar", "char_head": "char"}.get(kind, kind)]
    ids = known_ids(text, charset, len(layout.before), lower)
    sym = lambda s: F.array(F.lit(layout.id_of(charset, s)))
    pad = lambda s: layout.id_of(charset, s)
    if kind == "ctc":
        out = _padded(ids, most, 0)
    elif kind == "ce":
        out = ids
    elif kind == "ar":
        out = _padded(F.concat(sym("<s>"), ids, sym("</s>")), most + 2, pad("<pad>"))
    elif kind == "ep":
        out = _padded(F.concat(ids, sym("</s>")), most + 1, pad("<pad>"))
    elif kind in ("char", "nrtr"):
        out = _padded(F.concat(sym("<s>"), ids, sym("</s>")), most + 2, 0)
    elif kind == "abinet":
        out = _padded(F.concat(ids, F.array(F.lit(0))), most + 1, 100)
    elif kind == "srn":
        out = _padded(ids, most, pad("<EOS>"))
    elif kind == "char_head":
        out = _padded(ids, most + 1, 104)
    elif kind == "visionlan":
        out = _padded(F.transform(ids, lambda i: i + 1), most + 1, 0)
    elif kind == "mgp":
        out = _padded(F.concat(sym("[GO]"), ids, sym("[s]")), most + 2, pad("[GO]"))
    elif kind in ("smtr", "igtr"):
        out = _padded(F.concat(sym("<s>"), ids, sym("</s>")), most + 2, pad("<pad>"))
    elif kind == "cppd":
        out = _padded(F.concat(ids, sym("</s>")), most + 1, 100)
    elif kind == "dptr":
        out = _padded(F.concat(sym("[B]"), ids, sym("[E]")), most + 2, pad("[P]"))
    else:
        raise ValueError(f"no encoder {kind}")
    size = F.length(text) if kind == "ce" else F.size(ids)
    return F.when((F.size(ids) > 0) & (size <= most), out)


def guided_label(text: Column, charset: list[str], gtc: str = "ar", most: int = 25, lower: bool = False) -> Column:
    """struct<label, ctc_label, ctc_length> for a model guided by attention; null if either label is."""
    guide, ctc = encoded(text, charset, gtc, most, lower), encoded(text, charset, "ctc", most, lower)
    return F.when(guide.isNotNull() & ctc.isNotNull(), F.struct(guide.alias("label"), ctc.alias("ctc_label"), F.size(known_ids(text, charset, 1, lower)).alias("ctc_length")))


def occluded_label(text: Column, at: Column, charset: list[str], most: int = 25, lower: bool = False) -> Column:
    """struct<label, length, label_res, length_res, label_sub, length_sub> of a text whose character at place `at` is covered: the ids of the
    whole, of the rest and of that character. Null where the whole has no label; what has no known character has length 0."""
    label = encoded(text, charset, "visionlan", most, lower)
    rest, one = F.concat(F.left(text, at), F.substr(text, at + 2)), F.substr(text, at + 1, F.lit(1))
    part = lambda x: F.filter(known_ids(x, charset, 1, lower), lambda i: i > 0)
    pair = lambda x, name: [_padded(part(x), most, 0).alias(f"label_{name}"), F.size(part(x)).alias(f"length_{name}")]
    return F.when(label.isNotNull(), F.struct(label.alias("label"), F.size(part(text)).alias("length"), *pair(rest, "res"), *pair(one, "sub")))


def node_label(text: Column, charset: list[str], most: int = 25, lower: bool = False, count_down: bool = False) -> Column:
    """struct<label, nodes> of the `cppd` layout: nodes are how often each class occurs (the end once), then a node for each place: whether it
    is used, or with `count_down` how many places are left (100 where it is not used)."""
    label, ids = encoded(text, charset, "cppd", most, lower), known_ids(text, charset, 1, lower)
    used = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.when(i > F.size(ids), 100 if count_down else 0).otherwise(F.size(ids) - i if count_down else 1))
    return F.when(label.isNotNull(), F.struct(label.alias("label"), F.concat(class_counts(F.concat(F.array(F.lit(0)), ids), len(charset) + 1), used).alias("nodes")))


def window_label(text: Column, charset: list[str], most: int = 25, k: int = 5, lower: bool = False, dice: Column | None = None) -> Column:
    """The `smtr` label: struct<label, subs, next, n_subs, subs_back, next_back, n_subs_back>.

    A window is the k symbols before a character (from the beginning on), or after it (from the end on), with the ends filled up; beside
    each list stands the character it tells, and the end symbol last. Both are padded to 2 * most + 2. `dice`, an array of
    struct<at, id, then_at, then_id> for windows k and later of either list, adds variants: a window with the id at place `at` replaced
    joins the list unless it is in it, then the window itself has the id at `then_at` replaced.
    """
    layout = LAYOUTS["smtr"]
    sym = {x: F.lit(layout.id_of(charset, x)) for x in ("</s>", "<INF>", "<INB>", "<pad>")}
    label, ids = encoded(text, charset, "smtr", most, lower), known_ids(text, charset, 1, lower)
    n, size = F.size(ids), 2 * most + 2
    filled = F.concat(F.array_repeat(sym["<INF>"], k), ids, F.array_repeat(sym["<INB>"], k))
    out = [label.alias("label")]
    for name, begin, told in (("", lambda i: i + 1, ids), ("_back", lambda i: n + k - i + 1, F.reverse(ids))):
        lists = F.struct(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(filled, begin(i), k)).alias("subs"), F.concat(told, F.array(sym["</s>"])).alias("next"))  # noqa: B023
        lists = lists if dice is None else _with_variants(lists, n, k, dice)
        out += [
            F.concat(lists["subs"], F.array_repeat(F.array_repeat(sym["<pad>"], k), F.greatest(F.lit(0), size - F.size(lists["subs"])))).alias(f"subs{name}"),
            _padded(lists["next"], size, layout.id_of(charset, "<pad>")).alias(f"next{name}"),
            F.size(lists["subs"]).alias(f"n_subs{name}"),
        ]
    return F.when(label.isNotNull(), F.struct(*out))


def _with_variants(lists: Column, n: Column, k: int, dice: Column) -> Column:
    put = lambda window, at, x: F.transform(window, lambda y, j: F.when(j == at, x).otherwise(y))

    def step(acc, t):
        die, window = F.get(dice, t - k), F.get(acc["subs"], t)
        new = put(window, die["at"], die["id"])
        known = F.array_contains(acc["subs"], new)
        subs = F.when(known, acc["subs"]).otherwise(F.concat(acc["subs"], F.array(new)))
        told = F.when(known, acc["next"]).otherwise(F.concat(acc["next"], F.array(F.get(acc["next"], t))))
        return F.struct(F.transform(subs, lambda w, j: F.when(j == t, put(window, die["then_at"], die["then_id"])).otherwise(w)).alias("subs"), told.alias("next"))

    late = F.when(n >= k, F.sequence(F.lit(k), n)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(late, lists, step)


def prompt_label(text: Column, charset: list[str], most: int = 25, lower: bool = False) -> Column:
    """The `igtr` label: struct<label, counts, prompts, questions>, without random splits.

    counts: how often each class occurs (the end once). prompts and questions, one array each: all characters asked with nothing told, and
    the end asked with all told. An element is struct<pos, id, nth> (place from 1, class, how many of its class come before); a
    prompt begins with the start symbol at 0, the last question is the end; both are padded to most + 1.
    """
    layout = LAYOUTS["igtr"]
    triple = lambda pos, x, nth: F.struct(F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.cast("int").alias("pos"), x.cast("int").alias("id"), nth.cast("int").alias("nth"))
    sym = lambda x: F.lit(layout.id_of(charset, x))
    label, ids = encoded(text, charset, "igtr", most, lower), known_ids(text, charset, 1, lower)
    told = F.transform(occurrences(ids), lambda o: triple(o["pos"] + 1, o["id"], o["nth"] - 1))
    pad, end = triple(most + 2, sym("<pad>"), F.lit(0)), F.array(triple(F.size(ids) + 1, sym("</s>"), F.lit(0)))
    full = lambda rows: F.concat(rows, F.array_repeat(pad, F.greatest(F.lit(0), most + 1 - F.size(rows))))
    start = F.array(triple(0, sym("<s>"), F.lit(0)))
    counts = class_counts(F.concat(F.array(F.lit(0)), ids), len(charset) + 1)
    return F.when(label.isNotNull(), F.struct(label.alias("label"), counts.alias("counts"), F.array(full(start), full(F.concat(start, told))).alias("prompts"), F.array(full(F.concat(told, end)), full(end)).alias("questions")))


def class_counts(ids: Column, classes: int) -> Column:
    """How often each class occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.size(F.filter(ids, lambda i: i == k)))


def occurrences(ids: Column) -> Column:
    """array<struct<pos, id, nth>>: place and running count of each class in a label."""
    return F.transform(ids, lambda x, i: F.struct(i.alias("pos"), x.alias("id"), F.size(F.filter(F.slice(ids, 1, i + 1), lambda y: y == x)).alias("nth")))


def contexts(ids: Column, k: int, open_id: int, close_id: int, end_id: int) -> Column:
    """array<struct<context, next, back, prev>>: each id after its k predecessors and before its k successors, with the ends padded."""
    n = F.size(ids)
    padded = F.concat(F.array_repeat(F.lit(open_id), k), ids, F.array_repeat(F.lit(close_id), k))
    nxt = F.concat(ids, F.array(F.lit(end_id)))
    prv = F.concat(F.array(F.lit(end_id)), ids)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.slice(padded, i + 1, k).alias("context"), F.get(nxt, i).alias("next"), F.slice(padded, i + k + 1, k).alias("back"), F.get(prv, i).alias("prev")))


def absent_symbols(ids: Column, classes: int) -> Column:
    return F.array_except(F.sequence(F.lit(0), F.lit(classes - 1)), ids)
