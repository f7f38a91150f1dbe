"""Kinematic chains from robot descriptions in URDF, for `geometry.forward_kinematics`."""

from __future__ import annotations

import math
from typing import NamedTuple
from xml.etree import ElementTree

from pyspark.sql import SparkSession

MOVING = ("revolute", "continuous", "prismatic")


class Joint(NamedTuple):
    name: str
    kind: str
    parent: str
    child: str
    xyz: tuple[float, ...]
    rpy: tuple[float, ...]
    axis: tuple[float, ...]


def _numbers(element, tag: str, attribute: str, default: tuple[float, ...]) -> tuple[float, ...]:
    found = element.find(tag)
    text = found.get(attribute) if found is not None else None
    out = tuple(float(x) for x in text.split()) if text else default
    if len(out) != len(default):
        raise ValueError(f"{tag} {attribute} of {element.get('name')!r} has not {len(default)} numbers")
    return out


def joints_of(xml: str) -> dict[str, Joint]:
    """The joints of a description by the link that each moves; a link with two joints above it fails."""
    out: dict[str, Joint] = {}
    for e in ElementTree.fromstring(xml).findall("joint"):
        child = e.find("child").get("link")
        if child in out:
            raise ValueError(f"two joints move {child}")
        out[child] = Joint(e.get("name", ""), e.get("type", "fixed"), e.find("parent").get("link"), child, _numbers(e, "origin", "xyz", (0, 0, 0)), _numbers(e, "origin", "rpy", (0, 0, 0)), _numbers(e, "axis", "xyz", (1, 0, 0)))
    return out


def chain(
    xml: str, base: str, tip: str, names: list[str], signs: list[float] | None = None, offsets: list[float] | None = None, degrees: bool = False, tool: tuple[tuple[float, ...], tuple[float, ...]] | None = None
) -> list[dict]:
    """Links from base to tip in order, as `geometry.forward_kinematics` takes them.

    names: the joints in the order of the joint vector; they must be the moving joints of the chain. Signs and offsets (in
    radians or metres) are theirs. degrees: the vector is in degrees. tool: (xyz, rpy) of the tool in the last link.
    """
    above = joints_of(xml)
    path, link, seen = [], tip, set()
    while link != base:
        if link not in above or link in seen:
            raise ValueError(f"no chain from {base} to {tip}: it ends at {link}")
        seen.add(link)
        path.append(above[link])
        link = above[link].parent
    path.reverse()
    moving = [j.name for j in path if j.kind in MOVING]
    if sorted(moving) != sorted(names):
        raise ValueError(f"the chain moves by {moving}, not by {names}")
    for given in (signs, offsets):
        if given is not None and len(given) != len(names):
            raise ValueError("a sign and an offset for each joint")
    unit = math.pi / 180 if degrees else 1.0
    out = []
    for j in path:
        if j.kind not in (*MOVING, "fixed"):
            raise ValueError(f"joint {j.name} is {j.kind}")
        step = {"kind": j.kind, "xyz": j.xyz, "rpy": j.rpy}
        if j.kind in MOVING:
            at = names.index(j.name)
            step |= {"axis": j.axis, "index": at, "sign": unit * (signs[at] if signs else 1.0), "offset": offsets[at] if offsets else 0.0}
        out.append(step)
    return out + ([{"kind": "fixed", "xyz": tool[0], "rpy": tool[1]}] if tool else [])


def read_chain(spark: SparkSession, path: str, *args, **options) -> list[dict]:
    """`chain` of one URDF file on any file system that Spark reads."""
    return chain(spark.read.text(path, wholetext=True).first()[0], *args, **options)
