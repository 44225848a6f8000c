"""Effective browser settings after a log of changes, and the preset tables they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Viewport presets.
VIEWPORTS = """
mobile 375 812
tablet 768 1024
desktop 1280 900
desktop-hd 1920 1080
desktop-2k 2560 1440
"""

# User agent presets.
USER_AGENTS = """
chrome-desktop | Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36
chrome-mobile | Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Mobile Safari/537.36
safari-desktop | Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Safari/605.1.15
safari-mobile | Mozilla/5.0 (iPhone; CPU iPhone OS 18_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Mobile/15E148 Safari/604.1
firefox-desktop | Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:133.0) Gecko/20100101 Firefox/133.0
"""

# Device presets (width, height, scale, mobile, touch, user agent).
DEVICES = """
iphone-15 | 393 852 3 true true | Mozilla/5.0 (iPhone; CPU iPhone OS 18_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Mobile/15E148 Safari/604.1
iphone-se | 375 667 2 true true | Mozilla/5.0 (iPhone; CPU iPhone OS 18_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Mobile/15E148 Safari/604.1
ipad | 820 1180 2 true true | Mozilla/5.0 (iPad; CPU OS 18_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Mobile/15E148 Safari/604.1
ipad-pro | 1024 1366 2 true true | Mozilla/5.0 (iPad; CPU OS 18_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Mobile/15E148 Safari/604.1
pixel-8 | 412 915 2.625 true true | Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Mobile Safari/537.36
galaxy-s24 | 360 780 3 true true | Mozilla/5.0 (Linux; Android 14; SM-S921B) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Mobile Safari/537.36
desktop-retina | 1280 900 2 false false | Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36
"""

DEFAULT_VIEWPORT = (1280, 900)


def dim_viewport(spark: SparkSession) -> DataFrame:
    rows = [(n, int(w), int(h)) for n, w, h in (line.split() for line in VIEWPORTS.strip().splitlines())]
    return spark.createDataFrame(rows, "viewport_preset string, vp_width int, vp_height int")


def dim_ua(spark: SparkSession) -> DataFrame:
    rows = [tuple(p.strip() for p in line.split("|")) for line in USER_AGENTS.strip().splitlines()]
    return spark.createDataFrame(rows, "ua_preset string, ua_text string")


def dim_device(spark: SparkSession) -> DataFrame:
    rows = []
    for line in DEVICES.strip().splitlines():
        name, nums, agent = (p.strip() for p in line.split("|"))
        w, h, scale, mobile, touch = nums.split()
        rows.append((name, int(w), int(h), float(scale), mobile == "true", touch == "true", agent))
    return spark.createDataFrame(
        rows,
        "device_preset string, d_width int, d_height int, d_scale double, d_mobile boolean, "
        "d_touch boolean, d_agent string",
    )


def resolved_changes(changes: DataFrame) -> DataFrame:
    """Each change with its presets looked up and its kind decided.

    A device preset, a scale or the mobile flag restarts the browser. A device preset
    decides viewport, scale, mobile, touch and user agent; otherwise a custom viewport
    beats a preset and a custom user agent beats a preset. Changes that set only one
    viewport side were refused.
    """
    spark = changes.sparkSession
    whole = changes.filter(F.col("viewport_width").isNull() == F.col("viewport_height").isNull())
    named = (
        whole.join(F.broadcast(dim_device(spark)), "device_preset", "left")
        .join(F.broadcast(dim_viewport(spark)), "viewport_preset", "left")
        .join(F.broadcast(dim_ua(spark)), "ua_preset", "left")
    )
    device = F.col("device_preset").isNotNull()
    restart = device | F.col("device_scale_factor").isNotNull() | F.col("is_mobile").isNotNull()
    size = (
        F.when(device, F.struct(F.col("d_width").alias("w"), F.col("d_height").alias("h")))
        .when(F.col("viewport_width").isNotNull(), F.struct(F.col("viewport_width").alias("w"), F.col("viewport_height").alias("h")))
        .when(F.col("vp_width").isNotNull(), F.struct(F.col("vp_width").alias("w"), F.col("vp_height").alias("h")))
    )
    agent = F.when(device, F.col("d_agent")).otherwise(
        F.nullif(F.coalesce("user_agent", "ua_text"), F.lit("")))
    return named.select(
        "profile", "seq", restart.alias("restart"), size.alias("viewport"),
        F.when(device, F.col("d_scale")).otherwise(F.col("device_scale_factor")).alias("scale"),
        F.when(device, F.col("d_mobile")).otherwise(F.col("is_mobile")).alias("mobile"),
        F.when(device, F.col("d_touch")).otherwise(F.col("is_mobile")).alias("touch"),
        agent.alias("agent"),
        F.nullif("locale", F.lit("")).alias("locale"),
        F.col("color_scheme").alias("scheme"),
        F.col("extra_headers").alias("headers"),
    )


def effective_settings(changes: DataFrame) -> DataFrame:
    """Settings in force per profile after all changes.

    A restart keeps what restarts have set so far and forgets everything set while running
    (including headers); its locale comes back as ``Accept-Language`` and the headers of the
    same change are applied after it. Everything is one aggregate per profile plus one per
    (profile, header), both with map-side combine.
    """
    rows = resolved_changes(changes)
    restart, live = F.col("restart"), ~F.col("restart")

    def kept(name: str):
        return F.max_by(name, F.when(restart & F.col(name).isNotNull(), F.col("seq")))

    def at_runtime(name: str):
        at = F.when(live & F.col(name).isNotNull(), F.col("seq"))
        return F.struct(F.max_by(name, at).alias("v"), F.max(at).alias("seq"))

    per_profile = rows.groupBy("profile").agg(
        F.max(F.when(restart, F.col("seq"))).alias("restart_seq"),
        F.count_if(restart).alias("restarts"),
        *[kept(n).alias(f"k_{n}") for n in ("viewport", "scale", "mobile", "touch", "agent", "locale", "scheme")],
        *[at_runtime(n).alias(f"r_{n}") for n in ("viewport", "agent", "locale", "scheme")],
    )

    def in_force(name: str):
        newer = F.col(f"r_{name}.seq") > F.coalesce("restart_seq", F.lit(-1))
        return F.when(newer, F.col(f"r_{name}.v")).otherwise(F.col(f"k_{name}"))

    settings = per_profile.select(
        "profile", "restart_seq", "restarts", "k_locale",
        F.coalesce(in_force("viewport"), F.struct(F.lit(DEFAULT_VIEWPORT[0]).alias("w"), F.lit(DEFAULT_VIEWPORT[1]).alias("h"))).alias("vp"),
        F.col("k_scale").alias("scale"), F.col("k_mobile").alias("mobile"), F.col("k_touch").alias("touch"),
        in_force("agent").alias("user_agent"), in_force("locale").alias("locale"),
        in_force("scheme").alias("color_scheme"),
    )

    def header(name: str, value, rank: int):
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(rank).alias("rank"))

    own = F.filter(
        F.array(
            header("User-Agent", F.when(live, F.col("agent")), 1),
            header("Accept-Language", F.when(live, F.col("locale")), 2),
        ),
        lambda h: h["value"].isNotNull(),
    )
    extra = F.transform(
        F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(3).alias("rank")),
    )
    sent = rows.select("profile", "seq", F.explode(F.concat(own, extra)).alias("h"))
    latest = sent.groupBy("profile", F.col("h.name").alias("name")).agg(
        F.max_by("h.value", F.struct("seq", "h.rank")).alias("value"), F.max("seq").alias("seq"))
    after_restart = settings.filter(F.col("k_locale").isNotNull()).select(
        "profile", F.lit("Accept-Language").alias("name"), F.col("k_locale").alias("value"),
        F.col("restart_seq").alias("seq"))
    marks = settings.select("profile", F.coalesce("restart_seq", F.lit(-1)).alias("restart_seq"))
    alive = latest.join(marks, "profile").filter(F.col("seq") >= F.col("restart_seq")).drop("restart_seq")
    headers = (
        alive.withColumn("by_change", F.lit(1)).unionByName(after_restart.withColumn("by_change", F.lit(0)))
        .groupBy("profile", "name")
        .agg(F.max_by("value", F.struct("seq", "by_change")).alias("value"))
        .groupBy("profile")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("headers"))
    )
    return settings.join(headers, "profile", "left").select(
        "profile", F.concat_ws("x", F.col("vp.w").cast("string"), F.col("vp.h").cast("string")).alias("viewport"),
        "scale", "mobile", "touch", "user_agent", "locale", "color_scheme", "headers", "restarts", "restart_seq",
    )


def tabs_closed_by_restart(changes: DataFrame, open_tabs: DataFrame) -> DataFrame:
    """Open tabs (profile, tab_id, opened_seq) that the profile's last restart closed."""
    restarts = resolved_changes(changes).filter("restart").groupBy("profile").agg(F.max("seq").alias("restart_seq"))
    return open_tabs.join(restarts, "profile").filter(F.col("opened_seq") <= F.col("restart_seq"))
