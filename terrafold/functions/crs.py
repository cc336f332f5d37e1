"""Coordinate systems by their text: WKT (1 and 2) and proj strings; units, codes, kinds."""

from __future__ import annotations

import re

#: Metres in a unit, by the names that proj strings give it.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937, "yd": 0.9144, "ind-yd": 0.91439523, "link": 0.201168, "ch": 20.1168}
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')


def parse_wkt(text: str) -> list:
    """[name, argument, ..] with arguments as strings, numbers, names or further lists."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not WKT at {at}")
        tokens.append(m)
        at = m.end()

    def value(k: int):
        quoted, name, number, mark = tokens[k].groups()
        if quoted is not None:
            return quoted.replace('""', '"'), k + 1
        if number is not None:
            return float(number), k + 1
        if mark is not None:
            raise ValueError("a value is missing")
        if k + 1 < len(tokens) and tokens[k + 1].group(4) in ("[", "("):
            out, k = [name.upper()], k + 2
            while tokens[k].group(4) not in ("]", ")"):
                if tokens[k].group(4) == ",":
                    k += 1
                    continue
                item, k = value(k)
                out.append(item)
            return out, k + 1
        return name, k + 1

    try:
        return value(0)[0]
    except IndexError:
        raise ValueError("the text ends early") from None


def _find(node: list, names: tuple[str, ...]) -> list | None:
    """The first direct part with one of the names."""
    return next((x for x in node[1:] if isinstance(x, list) and x[0] in names), None)


def _horizontal(node: list) -> list:
    """Of a compound or bound system the horizontal one."""
    if node[0] in ("COMPD_CS", "COMPOUNDCRS"):
        return _horizontal(next(x for x in node[1:] if isinstance(x, list) and not x[0].startswith("VERT")))
    if node[0] == "BOUNDCRS":
        return _horizontal(_find(_find(node, ("SOURCECRS",)), ("PROJCRS", "GEOGCRS", "GEODCRS", "COMPOUNDCRS")))
    return node


def wkt_epsg(text: str) -> int | None:
    """The code that the whole system names, not those of its parts."""
    node = _horizontal(parse_wkt(text))
    mark = _find(node, ("AUTHORITY", "ID"))
    return int(mark[2]) if mark and str(mark[1]).upper() == "EPSG" else None


def is_geographic(text: str) -> bool:
    """Whether coordinates are longitude and latitude; of a WKT or proj string."""
    if text.lstrip().startswith("+"):
        return bool(re.search(r"\+proj=(longlat|latlong|lonlat)\b", text))
    return _horizontal(parse_wkt(text))[0] in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS")


def metres_per_unit(text: str | None) -> float | None:
    """Metres in one unit of a projected system; None for geographic, local or unknown ones."""
    if not text:
        return None
    try:
        if is_geographic(text):
            return None
        if text.lstrip().startswith("+"):
            if not re.search(r"\+proj=\S+", text):
                return None
            own = re.search(r"\+to_meter=([0-9.eE+-]+)", text)
            if own:
                return float(own[1]) if float(own[1]) > 0 else None
            unit = re.search(r"\+units=(\S+)", text)
            return UNITS.get(unit[1]) if unit else 1.0
        node = _horizontal(parse_wkt(text))
    except (ValueError, StopIteration, TypeError):
        return None
    if node[0] not in ("PROJCS", "PROJCRS", "PROJECTEDCRS"):
        return None
    axis = _find(node, ("CS",))
    unit = _find(node, ("UNIT", "LENGTHUNIT"))
    if unit is None:  # WKT 2 may name the unit with each axis
        unit = next((u for a in node[1:] if isinstance(a, list) and a[0] == "AXIS" for u in a[1:] if isinstance(u, list) and u[0] == "LENGTHUNIT"), None)
    return float(unit[2]) if unit is not None else (1.0 if axis is None else None)


def unit_label(text: str | None) -> str:
    """m, ft, US-ft, or that the unit isn't known."""
    factor = metres_per_unit(text)
    known = {"m": 1.0, "ft": UNITS["ft"], "US-ft": UNITS["us-ft"]}
    return next((k for k, v in known.items() if factor is not None and abs(factor - v) < 1e-9), "CRS units")


def to_units(metres: float, text: str | None) -> float:
    """Metres in a system's units; as they are where it has none."""
    return metres / (metres_per_unit(text) or 1.0)
