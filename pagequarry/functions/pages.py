"""Page and photo rules as column expressions: print plan, boxes, wording, options, outcome classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Corner words, resolution unit code for centimetres, choices.
CORNERS = ("top-left", "top-right", "bottom-left", "bottom-right")
PER_CENTIMETRE = 3
FITS = ("auto", "stretch", "fit", "fill")
ROTATIONS = (0, 90, 180, 270)
CURVATURE_MODES = ("auto", "off", "force")
BINDINGS = ("auto", "left", "right", "top", "bottom")
SLEEVE_MODES = ("auto", "off")
CROPS = ("paper", "sleeve")


def print_plan(width: Column, height: Column, long_in: Column, short_in: Column, dpi: Column, fit: Column, tolerance: float = 0.02, low_dpi: float = 150.0, bleed_in: float = 0.0) -> dict[str, Column]:
    """How a page is printed at its size: orientation, pixels, capture resolution, fit and warnings.

    The long side of the size goes with the long side of the page. Pixel
    counts round half to even.
    """
    landscape = width >= height
    w_in, h_in = F.when(landscape, long_in).otherwise(short_in), F.when(landscape, short_in).otherwise(long_in)
    aspect_page, aspect_size = width / height, w_in / h_in
    mismatch = F.abs(aspect_page / aspect_size - 1)
    used = F.when(fit == "auto", F.when(mismatch <= tolerance, "stretch").otherwise("fit")).otherwise(fit)
    capture = F.greatest(width, height) / long_in
    bleed = F.bround(F.lit(bleed_in) * dpi, 0).cast("int")
    # Fixed wording.
    aspect = F.format_string("page measures %.3f (w/h) but the page size is %.3f; printed with fit=%s. Check the page size, or whether the right page was found.", aspect_page, aspect_size, used)
    upsampled = F.concat(F.lit("captured at "), F.bround(capture, 0).cast("int"), F.lit(" dpi, upsampled to "), dpi.cast("int"), F.lit(" dpi"))
    low = F.concat(F.lit("captured at only "), F.bround(capture, 0).cast("int"), F.lit(" dpi; shoot closer or in overlapping parts"))
    warning = lambda cond, code, text: F.when(cond, F.struct(F.lit(code).alias("code"), text.alias("message")))
    return {
        "size_w": F.bround(w_in, 4), "size_h": F.bround(h_in, 4),
        "px_w": F.bround(w_in * dpi, 0).cast("int") + 2 * bleed, "px_h": F.bround(h_in * dpi, 0).cast("int") + 2 * bleed,
        "bleed_px": bleed, "capture_dpi": F.bround(capture, 1), "fit_used": used,
        "aspect_page": F.bround(aspect_page, 4), "aspect_size": F.bround(aspect_size, 4),
        "warnings": F.array_compact(F.array(warning(mismatch > tolerance, "aspect_mismatch", aspect), warning(capture < dpi, "upsampled", upsampled), warning(capture < low_dpi, "low_resolution", low))),
    }


def percent(fraction: Column) -> Column:
    """Percent with one decimal, a tie going to the even digit."""
    return F.format_string("%.1f%%", F.bround(fraction * 100, 1))


def place_word(location: Column, has_edges: Column) -> Column:
    return F.when(location.isin(*CORNERS), F.concat(location, F.lit(" corner"))).when(location == "centre", location).when(has_edges, F.concat(location, F.lit(" edge"))).otherwise(location)


def scan_wording(code: Column, message: Column, source: Column, scan_dpi: Column) -> Column:
    """A low-resolution warning in the words of a scanned page."""
    at = F.when(scan_dpi.isNotNull() & (scan_dpi != 0), F.concat(F.lit(" (scanned at "), F.bround(scan_dpi, 0).cast("int"), F.lit(" dpi)"))).otherwise("")
    return F.when((code == "low_resolution") & (source == "scan"), F.concat(F.split(message, ";")[0], at, F.lit("; scan at a higher resolution"))).otherwise(message)


def added_warnings(codes: Column, coverage: Column, dropped: Column, threshold: float = 0.99) -> Column:
    """Coverage and dropped-photo warnings added where the page raised none of its own."""
    warning = lambda cond, code, text: F.when(cond, F.struct(F.lit(code).alias("code"), text.alias("message")))
    missing = warning((coverage < threshold) & ~F.array_contains(codes, "incomplete_coverage"), "incomplete_coverage", F.concat(F.lit("photos cover only "), percent(coverage), F.lit(" of the page")))
    lost = warning((F.size(dropped) > 0) & ~F.array_contains(codes, "photos_dropped"), "photos_dropped", F.concat(F.lit("photos ["), F.array_join(dropped, ", "), F.lit("] matched no other photo and were not used")))
    return F.array_compact(F.array(missing, lost))


def scanner_outcome(status: Column) -> Column:
    """What the scanner does after a response (null status: unreachable)."""
    return F.when(status.isNull(), "retry").when(status.isin(200, 201, 204), "done").when((status >= 500) | (status == 429), "retry").when(status == 401, "auth").otherwise("blocked")


def phone_outcome(status: Column, kind: Column, attempts: Column) -> Column:
    """What the phone does after a response: done, drop, retry or auth. A shot's first 400 is tried once more."""
    shot = kind == "PUT_SHOT"
    return (
        F.when(status.isNull(), "retry")
        .when(status.isin(401, 403), "auth")
        .when((status >= 200) & (status < 300), "done")
        .when((status == 404) & (kind == "MOVE_SHOTS"), "drop")
        .when(status == 400, F.when(shot & (attempts < 1), "retry").otherwise("drop"))
        .when(status.isin(409, 413, 422), "drop")
        .otherwise("retry")
    )


def shot_box_extent(x0: Column, y0: Column, x1: Column, y1: Column, h: list[Column]) -> Column:
    """The extent (x0, y0, x1, y1) of 36 points along a box's outline taken through a homography (nine columns, row by row).

    Many boxes at a time as arrays: points built and walked row by row are many times slower. Null where no point is seen.
    """
    names = ("x0", "y0", "x1", "y1")

    def extent(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, *h: pd.Series) -> pd.DataFrame:
        x0, y0, x1, y1, *h = (c.to_numpy(float) for c in (x0, y0, x1, y1, *h))
        low, high = np.full((2, len(x0)), np.nan), np.full((2, len(x0)), np.nan)
        for k in range(9):
            x, y = x0 + k / 8.0 * (x1 - x0), y0 + k / 8.0 * (y1 - y0)
            for px, py in ((x, y0), (x, y1), (x0, y), (x1, y)):
                w = h[6] * px + h[7] * py + h[8]
                w = np.where(w != 0, w, np.nan)
                place = np.stack([(h[0] * px + h[1] * py + h[2]) / w, (h[3] * px + h[4] * py + h[5]) / w])
                low, high = np.fmin(low, place), np.fmax(high, place)
        return pd.DataFrame(dict(zip(names, (*low, *high))))

    udf = F.pandas_udf(extent, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    return udf(*[c.cast("double") for c in (x0, y0, x1, y1, *h)])


def shot_box(extent: Column, width: Column, height: Column) -> Column:
    """The extent of a mapped outline clipped to the shot; null where the box misses it."""
    bx0, bx1 = F.greatest(F.floor(extent["x0"]), F.lit(0)), F.least(F.ceil(extent["x1"]), width - 1)
    by0, by1 = F.greatest(F.floor(extent["y0"]), F.lit(0)), F.least(F.ceil(extent["y1"]), height - 1)
    some = extent["x0"].isNotNull() | extent["y0"].isNotNull()
    return F.when(some & (bx1 > bx0) & (by1 > by0), F.array(*[c.cast("int") for c in (bx0, by0, bx1, by1)]))


def shot_rect(box: Column, width: Column, height: Column) -> Column:
    """A box in shot pixels (right and bottom included) as fractions of the photo."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    at = lambda i: F.get(box, F.lit(i))
    return F.when(box.isNotNull() & (width > 0) & (height > 0), F.array(clamp(at(0) / width), clamp(at(1) / height), clamp((at(2) + 1) / width), clamp((at(3) + 1) / height)))


def is_scan(software: Column, marker: str) -> Column:
    """Whether a photo's software text starts with the mark the scanner writes."""
    return F.coalesce(software.startswith(marker), F.lit(False))


def scan_dpi(resolution: Column, unit: Column) -> Column:
    dpi = F.when(F.coalesce(unit, F.lit(2)) == PER_CENTIMETRE, resolution * 2.54).otherwise(resolution)
    return F.bround(dpi.cast("double"), 2)


def rectangle_aspect(corners: list[tuple[Column, Column]], cx: Column, cy: Column, focal: Column) -> Column:
    """Width over height of the real rectangle seen as four corners (top-left, top-right, bottom-right, bottom-left).

    The single-view rectangle geometry of Zhang and He (whiteboard scanning,
    2007). ``focal`` is in pixels; null solves it from the corners. Falls back to
    the ratio of mean side lengths where the solution is not to be trusted.
    """
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = corners
    dist = lambda ax, ay, bx, by: F.hypot(ax - bx, ay - by)
    wide = (dist(trx, try_, tlx, tly) + dist(brx, bry, blx, bly)) / 2
    high = (dist(blx, bly, tlx, tly) + dist(brx, bry, trx, try_)) / 2
    naive = F.try_divide(wide, high)
    m = [(x - cx, y - cy) for x, y in ((tlx, tly), (trx, try_), (blx, bly), (brx, bry))]
    m1, m2, m3, m4 = m
    # Determinant of three image points with third coordinate 1.
    det = lambda p, q, r: (p[1] - q[1]) * r[0] - (p[0] - q[0]) * r[1] + (p[0] * q[1] - p[1] * q[0])
    k2, k3 = F.try_divide(det(m1, m4, m3), det(m2, m4, m3)), F.try_divide(det(m1, m4, m2), det(m3, m4, m2))
    n2 = (k2 * m2[0] - m1[0], k2 * m2[1] - m1[1], k2 - 1)
    n3 = (k3 * m3[0] - m1[0], k3 * m3[1] - m1[1], k3 - 1)
    solved = F.when(F.abs(n2[2] * n3[2]) >= 1e-9, F.try_divide(-(n2[0] * n3[0] + n2[1] * n3[1]), n2[2] * n3[2]))
    span = F.greatest(wide, high)
    trusted = F.when((solved > 0) & (solved > (0.3 * span) * (0.3 * span)) & (solved < (20 * span) * (20 * span)), solved)
    f2 = F.coalesce(focal * focal, trusted)
    aspect = F.sqrt(F.try_divide(F.try_divide(n2[0] * n2[0] + n2[1] * n2[1], f2) + n2[2] * n2[2], F.try_divide(n3[0] * n3[0] + n3[1] * n3[1], f2) + n3[2] * n3[2]))
    return F.when((aspect > 0.5 * naive) & (aspect < 2.0 * naive), aspect).otherwise(naive)


def source_options(source: Column, glare: Column, curvature: Column, shadow: Column) -> Column:
    """Options of a page by how it was captured: scans switch the checks off."""
    scan = source == "scan"
    return F.struct(F.when(scan, False).otherwise(glare).alias("glare"), F.when(scan, "off").otherwise(curvature).alias("curvature"), F.when(scan, False).otherwise(shadow).alias("shadow"))


def metadata_errors(name: Column, size_ok: Column, pages: Column, created: Column, unknown: Column) -> Column:
    """Everything wrong with an album's metadata, as short texts."""
    bad_ids = F.filter(pages, lambda p: ~F.lower(p).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
    rule = lambda cond, text: F.when(cond, F.lit(text))
    required = [rule(c.isNull(), f"{n}: required") for n, c in (("name", name), ("pages", pages), ("created", created))]
    return F.array_compact(
        F.array(
            *required,
            rule(F.trim(name) == "", "name: must not be blank"),
            rule(~size_ok, "page_size: cannot be parsed"),
            rule(F.size(bad_ids) > 0, "pages: not a UUID"),
            rule(F.size(F.array_distinct(F.transform(pages, lambda p: F.lower(p)))) < F.size(pages), "pages: listed twice"),
            rule(created.isNotNull() & ~created.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"), "created: not an ISO 8601 time"),
            rule(F.size(unknown) > 0, "unknown key"),
        )
    )


def page_options(own: dict[str, Column], album: dict[str, str]) -> dict[str, Column]:
    """The album's options with a page's own ones over them."""
    return {name: F.coalesce(own[name], F.lit(default)) if name in own else F.lit(default) for name, default in album.items()}
