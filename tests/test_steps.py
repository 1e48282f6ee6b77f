"""A small study from files to the coefficient table."""

from __future__ import annotations

import numpy as np

from paneldrift.functions.geometry import RINGS_TYPE
from paneldrift.plans import steps
from paneldrift.sources.tables import PROFILE_TERMS

from conftest import rows

N = 48  # units on an 8 x 6 grid of unit squares; areas are the eight columns


def box(x, y, w, h):
    return [[(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]


def test_study_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    units = [35000000 + i for i in range(N)]
    values = {(u, y): int(rng.integers(50, 900)) for u in units for y in (1971, 1981) if rng.random() < 0.9}
    raw = tmp_path / "raw"
    for y in (1971, 1981):
        have = [u for u in units if (u, y) in values]
        half = len(have) // 2
        for part, suffix in ((have[:half], ""), (have[half:], "_v2")):
            city = [] if suffix else ["TORONTO CMA"]
            total = [] if suffix else [str(sum(values[u, y] for u in have))]
            path = raw / f"{y} data" / f"a{suffix}.csv"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(
                ",".join([f"{y} Census", *city, *map(str, part)]) + "\n"
                + ",".join(["Population", *total, *(str(values[u, y]) for u in part)]) + "\n"
            )
    long_file = raw / "long.csv"
    latest = {u: int(rng.integers(50, 900)) for u in units}
    long_file.write_text(
        "geo,pop\nTORONTO (x)," + str(sum(latest.values())) + "\n"
        + "".join(f"{u} (00000),{v}\n" for u, v in latest.items())
    )
    out = str(tmp_path / "out")
    base = steps.ingest(spark, str(raw), out, {1991: str(long_file)}, {"35": "Toronto"}, "Vancouver")
    assert base["panel"].count() == len(values) + N and base["aggregate"].count() == 3

    (tmp_path / "units.csv").write_text(
        '"DAUID,C,8","PRNAME,C,100","CSDNAME,C,100","CCSNAME,C,100","CDNAME,C,100","CMANAME,C,100"\n'
        + "".join(f"{u},ON,Toronto,cc,d,Toronto\n" for u in [*units, 99])
    )
    head = ",".join(f"c{i}" for i in range(14))
    lines = [
        f"2016,{u},,,,,,,\"{term}\",,,{int(rng.integers(1, 90))},,"
        for u in [*units, 99] for term in PROFILE_TERMS
    ]
    (tmp_path / "profile.csv").write_text(head + "\n" + "\n".join(lines) + "\n")
    links = spark.createDataFrame(
        [(str(u), "Toronto", f"P{u % 3}", 43.0 + i / 100, -79.0) for i, u in enumerate(units)] + [("x1", "T", "P0", 0.0, 0.0)],
        "DA_dauid string, DA_csdname string, PostCode string, Latitude double, Longitude double",
    )
    cities = spark.createDataFrame([("P0", "York"), ("P1", "Etobicoke")], "postcode string, city string")
    about = steps.describe_units(
        spark, out, base["panel"], str(tmp_path / "units.csv"), steps.read_bridge(links), cities,
        "Toronto", {"ON": str(tmp_path / "profile.csv")},
    )
    assert about["dictionary"].count() == N and about["profile"].count() == N
    assert {r["csd_alt"] for r in about["bridge"].collect()} == {"York", "Etobicoke", "Toronto"}

    found = steps.analyse(spark, out, base["panel"], base["aggregate"], about["bridge"])
    assert rows(found["reconciliation"], "err") == [(0.0,), (0.0,), (0.0,)]
    change = {r["y1"]: r["change"] for r in found["decomposition"].collect()}
    sums = {y: sum(v for (_, z), v in values.items() if z == y) for y in (1971, 1981)}
    assert change == {1971: sums[1981] - sums[1971], 1981: sum(latest.values()) - sums[1981]}
    total = [r for r in found["area_totals"].where("tt = 'Net Total'").collect()]
    assert [(r["d_m"], r["pct"]) for r in total] == [(sum(latest.values()) - sums[1971], 1.0)]

    kind = f"id bigint, name string, ord int, rings {RINGS_TYPE}"
    squares = spark.createDataFrame(
        [(u, str(u), i, box(i % 8 + 0.25, i // 8 + 0.25, 0.5, 0.5)) for i, u in enumerate(units)], kind
    )
    areas = spark.createDataFrame([(i, f"Area{i} ({i})", i, box(i, 0, 1, 6 + i % 3)) for i in range(8)], kind)
    mapped = steps.map_areas(
        spark, out, {**found, **about}, squares, areas, "Toronto", 1991, {"Toronto": "Old Toronto"}
    )
    assert mapped["unit_area"].groupBy("area").count().where("count = 6").count() == 8
    per_area = {
        f"Area{a}": sum(latest[u] - values.get((u, 1971), 0) for i, u in enumerate(units) if i % 8 == a)
        for a in range(8)
    }
    assert {r["area"]: r["d_m"] for r in mapped["model"].collect()} == per_area
    assert mapped["area_edges"].count() == N * 4
    shares = mapped["model"].selectExpr("round(singd + semd + row + apt, 6) as s")
    assert {r["s"] for r in shares.collect()} == {1.0}
    table = steps.fit_model(mapped["model"])
    assert table.count() == 5 and table.first()["n"] == 8
