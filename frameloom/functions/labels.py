"""Texts and small decisions over detections, faces and hands, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.vectors import argmax, expectation, softmax

#: Relation words that are stored as data.
NEAR, RIGHT, LEFT, BELOW, ABOVE, OVERLAPS = "cerca", "a la derecha", "a la izquierda", "abajo", "arriba", "superpuesto a"
#: Middles of age groups.
AGE_CENTERS = (1.0, 5.0, 10.0, 18.0, 28.0, 40.5, 50.5, 80.0)


def mapped(label: Column, names: Mapping[str, str]) -> Column:
    """A label's own name, whatever its case and outer spaces; others stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[F.lower(F.trim(label))], label) if names else label


def natural_key(name: Column) -> Column:
    """Sorts names with numbers by value: digit runs padded, letters lower-cased."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "\u0001")


def reference(person: Column, track: Column) -> Column:
    """By what a person is referred to: the identity, else the track; zero counts as neither."""
    return F.coalesce(F.nullif(person, F.lit(0)), F.nullif(track, F.lit(0)), F.lit(0)).cast("long")


def relations(nx: Column, ny: Column, near: float = 0.15) -> Column:
    """Relation words of offsets in widths and heights of the reference box."""
    return F.array_compact(
        F.array(
            F.when((F.abs(nx) < near) & (F.abs(ny) < near), NEAR),
            F.when(nx > 0.2, RIGHT).when(nx < -0.2, LEFT),
            F.when(ny > 0.3, BELOW).when(ny < -0.3, ABOVE),
        )
    )


def sentence(person: Column, phrase: Column, other: Column) -> Column:
    """A relation as a sentence, in the language of its words."""
    return F.concat(F.lit("Persona "), person.cast("string"), F.lit(" está "), phrase, F.lit(" de "), other.cast("string"), F.lit("."))


def box_label(class_name: Column, confidence: Column) -> Column:
    """What is written at a box: its class and how sure that is; the class alone where that is not known."""
    return F.concat_ws(" ", class_name, F.when(confidence.isNotNull(), F.format_string("%.3f", confidence.cast("double"))))


def person_lines(pose: Column, pose_conf: Column, track: Column, person: Column) -> Column:
    """What is written beside a person's box, line by line; what is not known has no line."""
    sure = F.coalesce(F.format_string(" (%.3f)", pose_conf.cast("double")), F.lit(""))
    sure = F.when(pose_conf.isNull(), "").otherwise(sure)
    lines = F.array(F.concat(F.lit("pose: "), pose, sure), F.concat(F.lit("track: "), track.cast("string")), F.concat(F.lit("pid: "), person.cast("string")))
    return F.array_join(F.array_compact(lines), "\n")


def stringified(value: Column, kind: str) -> Column:
    """A metadata value as text; null is the word None."""
    text = F.when(value, "true").otherwise("false") if kind == "boolean" else value.cast("string")
    return F.when(value.isNull(), "None").otherwise(text)


def age_of(scores: Column) -> Column:
    """(age, adult, confidence) of a model's output: a number, ages 0 to 99 or 100, eight age groups, or classes. Ten numbers
    stand for age groups too, of which only eight have a middle, and give no age."""
    n, p = F.size(scores), softmax(scores)
    years = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("double"))
    centers = F.slice(F.array(*map(F.lit, AGE_CENTERS)), 1, n)
    age = F.when(n == 1, F.bround(scores[0])).when(n.isin(100, 101), F.bround(expectation(p, years))).when(n == 8, F.bround(expectation(p, centers))).when(n != 10, argmax(p)).cast("int")
    sure = F.when(n == 1, 1.0).otherwise(F.array_max(p))
    return F.struct(age.alias("age"), (age >= 18).alias("adult"), sure.alias("confidence"))


def attention(dx: Column, dy: Column) -> Column:
    """1 for a gaze at the middle, falling to 0 at the limits; across counts for more than up and down."""

    def axis(v: Column, middle: float, limit: float) -> Column:
        return F.when(F.abs(v) <= middle, 1.0).when(F.abs(v) >= limit, 0.0).otherwise(1 - (F.abs(v) - middle) / (limit - middle))

    return F.round(axis(dx, 0.05, 0.25) * 0.7 + axis(dy, 0.05, 0.20) * 0.3, 3)


#: Names of emotions in the order of a model's scores; landmarks of a face mesh around the eyes, of the irises
#: and of the lips, and how many a mesh has.
EMOTIONS = ("neutral", "feliz", "triste", "sorpresa", "miedo", "enojo", "disgusto")
LEFT_EYE, RIGHT_EYE = (33, 160, 158, 133, 153, 144, 163, 7, 246), (362, 385, 387, 263, 373, 380, 390, 249, 466)
LEFT_IRIS, RIGHT_IRIS, UPPER_LIP, LOWER_LIP, LANDMARKS = 468, 473, 13, 14, 478


def emotion_of(scores: Column, names: Sequence[str] = EMOTIONS) -> Column:
    """(label, confidence) of a model's scores: the name of the first best, or class_ and its place where it has no name;
    without scores no label, and a confidence of 0."""
    top = F.array_max(scores)
    total = F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    place = argmax(scores).cast("int")
    label = F.coalesce(F.get(F.array(*map(F.lit, names)), place), F.concat(F.lit("class_"), place.cast("string")))
    sure = F.coalesce(1 / (total + 1e-8), F.lit(0.0))
    known = F.coalesce(F.size(scores), F.lit(0)) > 0
    return F.struct(F.when(known, label).alias("label"), F.when(known, sure).otherwise(0.0).alias("confidence"))


def gaze(marks: Column) -> tuple[Column, Column]:
    """How far the irises are from the middles of the eyes, in widths and heights of the eyes: the mean of both."""

    def off(eye: tuple[int, ...], iris: int, axis: str) -> Column:
        values = F.array(*(marks[i][axis].cast("double") for i in eye))
        middle = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / len(eye)
        return (marks[iris][axis] - middle) / F.greatest(F.array_max(values) - F.array_min(values), F.lit(1e-6))

    dx, dy = ((off(LEFT_EYE, LEFT_IRIS, a) + off(RIGHT_EYE, RIGHT_IRIS, a)) / 2 for a in ("x", "y"))
    return dx, dy


def face_of(marks: Column) -> Column:
    """(attention, mouth: (state, ratio)) of the landmarks (x, y) of a face mesh; null for a mesh without irises."""

    def whole(m: Column) -> Column:
        up, low = m[UPPER_LIP], m[LOWER_LIP]
        ratio = F.hypot(up["x"] - low["x"], up["y"] - low["y"]).cast("double")
        mouth = F.struct(mouth_state(ratio).alias("state"), F.round(ratio, 3).alias("ratio"))
        return F.when(F.size(m) >= LANDMARKS, F.struct(attention(*gaze(m)).alias("attention"), mouth.alias("mouth")))

    # in a list of one, so that the landmarks are computed once
    return F.element_at(F.transform(F.array(marks), whole), 1)


def mouth_state(ratio: Column, bar: float = 0.05) -> Column:
    return F.when(ratio > bar, "abierta").otherwise("cerrada")


def eye_aspect(points: Column) -> Column:
    """Height over width of an eye of six points, from the outer corner around."""

    def apart(a: int, b: int) -> Column:
        return F.hypot(points[a]["x"] - points[b]["x"], points[a]["y"] - points[b]["y"])

    return F.when(apart(0, 3) > 0, (apart(1, 5) + apart(2, 4)) / (apart(0, 3) * 2))


def gesture(marks: Column, hand: Column) -> Column:
    """Gesture of 21 hand landmarks (x, y); y grows downward."""
    fingers = [(8, 6), (12, 10), (16, 14), (20, 18)]
    up = [(marks[t]["y"] < marks[p]["y"]).cast("int") for t, p in fingers]
    side = F.when(hand == "Right", marks[4]["x"] < marks[3]["x"]).otherwise(marks[4]["x"] > marks[3]["x"])
    folded = F.lit(True)
    for t, p in fingers:
        folded = folded & (marks[t]["y"] >= marks[p]["y"] - 0.02)
    upright = F.lit(True)
    for k in (3, 2, 0):
        upright = upright & (marks[4]["y"] + 0.02 < marks[k]["y"])
    total = up[0] + up[1] + up[2] + up[3] + side.cast("int")
    return F.when(folded & upright & side, "pulgar_arriba").when(total == 0, "puño").when(total == 5, "palma").otherwise("otro")
