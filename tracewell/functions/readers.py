"""Readings of face vectors: expression weights, landmarks (x, y, z of each point in one flat array) and rotation matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.numbers import dim

# fixed values: places in the expression weights, first left and then right; the neutral weight and those of where the eyes look
BLINK, SMILE, JAW = (9, 10), (42, 43), 25
NEUTRAL, LOOK, WEIGHTS = 0, range(11, 19), 52
# fixed values: landmark numbers of iris diameters (across, along), lids, corners of the eyes, nose and cheeks; right eye first
IRIS = (((469, 471), (470, 472)), ((474, 476), (475, 477)))
LIDS = ((159, 145), (386, 374))
CORNERS = ((33, 133), (362, 263))
NOSE, CHEEKS = 1, (234, 454)
_LEAST = 1e-9


def greater_side(weights: Column, sides: tuple[int, int]) -> Column:
    """The greater of the left and the right weight."""
    return F.greatest(*(dim(weights, i) for i in sides))


def expression(weights: Column) -> Column:
    """The greatest weight that is neither neutral nor of where the eyes look."""
    return F.array_max(F.array(*[dim(weights, i) for i in range(WEIGHTS) if i != NEUTRAL and i not in LOOK]))


def _apart(points: Column, a: int, b: int, axes: int) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow(dim(points, 3 * a + i) - dim(points, 3 * b + i), 2) for i in range(axes)]))


def pupil_visibility(points: Column) -> Column:
    """How far the lids are apart in iris diameters, in the picture's plane; mean of both eyes."""
    eyes = [_apart(points, *lids, 2) / ((_apart(points, *across, 2) + _apart(points, *along, 2)) / 2 + _LEAST) for lids, (across, along) in zip(LIDS, IRIS)]
    return (eyes[0] + eyes[1]) / 2


def frontality(points: Column) -> Column:
    """0 if both cheeks are as far from the nose sideways, more the more they differ: the absolute log ratio."""
    right, left = (F.abs(dim(points, 3 * cheek) - dim(points, 3 * NOSE)) + _LEAST for cheek in CHEEKS)
    return F.abs(F.log(right / left))


def eye_openness(points: Column) -> Column:
    """How far the lids are apart in eye widths, in space; mean of both eyes."""
    eyes = [_apart(points, *lids, 3) / (_apart(points, *corners, 3) + _LEAST) for lids, corners in zip(LIDS, CORNERS)]
    return (eyes[0] + eyes[1]) / 2


def rotation_angles(matrix: Column, mirrored: bool = False) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) in degrees of a row-major 3x3 rotation; mirrored: in a frame whose three axes all turn the other way."""
    m = lambda i: dim(matrix, i)
    yaw = F.degrees(F.atan2(-m(6), F.hypot(m(0), m(3))))
    pitch, roll = F.degrees(F.atan2(m(7), m(8))), F.degrees(F.atan2(m(3), m(0)))
    return (-yaw, -pitch, -roll) if mirrored else (yaw, pitch, roll)
