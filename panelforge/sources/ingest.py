"""The nineteen ingest jobs as one table-driven plan: scan, rename, require, audit, write, register."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import key_token
from ..operators.cleaning import audit, rename_typed, require
from .readers import read_csv
from .writers import register, write_parquet

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Source:
    """One raw file: header columns (with types), stored names, partitioning, literals."""

    schema: str
    system: str
    rename: dict[str, str] = field(default_factory=dict)
    entity: str | None = "city"
    parts: tuple[str, ...] = ("year", "country")
    country: str | None = "city"  # column whose last token is the country
    mode: str = "DROPMALFORMED"
    nulls: dict[str, str] = field(default_factory=dict)
    literals: dict[str, str] = field(default_factory=dict)


MONTH = "City string, Year int, Month int, "
YEAR = "City string, Year int, "
PLACE = {"lat": "double", "lon": "double"}

SOURCES: dict[str, Source] = {
    "vegetation": Source(MONTH + "NDVI_Mean double, NDVI_Std double, pixel_count int", "GEE_S2",
                         {"pixel_count": "ndvi_valid_pixels"}, mode="PERMISSIVE", nulls=PLACE),
    "no2": Source(MONTH + "NO2_Mean double, NO2_Std double, pixel_count int", "GEE_S5P",
                  {"pixel_count": "no2_valid_pixels"}, mode="PERMISSIVE", nulls=PLACE),
    "sealing": Source(YEAR + "Imperviousness_Mean double, Tree_Cover_Pct double, Small_Woody_Mean double",
                      "Copernicus_HRL", nulls=PLACE),
    "market": Source("Ticker string, Company_Name string, Sector string, Industry string, Country string, FUA_Country_Code string, "
                     "Year int, Month int, Close_Price double, Monthly_Return double, Monthly_Volatility double, "
                     "Volume_Avg double, Current_PE double, Current_Beta double, Extraction_Date string", "YFinance",
                     entity="ticker", parts=("year", "country_code"), country=None),
    "gdp": Source(YEAR + "GDP_Per_Capita double, Source string", "Eurostat_API",
                  {"city": "geo_code", "gdp_per_capita": "gdp_value", "source": "obs_flag"}, entity="geo_code", country="geo_code",
                  nulls={"geo_label": "string"}, literals={"unit": "EUR_HAB", "_dataset_code": "met_10r_3gdp/nama_10r_3gdp"}),
    "climate": Source(MONTH + "Temp_Mean_C double, Precip_Total_m double", "GEE_ERA5"),
    "aerosol": Source(MONTH + "UVAI_Mean double, UVAI_Std double, pixel_count int", "GEE_S5P_AER", {"pixel_count": "uvai_valid_pixels"}),
    "land_cover": Source(YEAR + "Tree_Pct double, Shrub_Pct double, Grass_Pct double, Crop_Pct double, Built_Pct double, "
                         "Bare_Pct double, Water_Pct double", "GEE_WorldCover",
                         {f"{c}_pct": f"wc_{c}_pct" for c in ("tree", "shrub", "grass", "crop", "built", "bare", "water")}),
    "emissions": Source(YEAR + "CO2_kt double, Country_Code string", "EDGAR_CO2", parts=("year", "country_code"), country=None),
    "policy": Source(YEAR + "EPS_Index double, Env_Tax_USD double, Env_Expenditure double, GHG_Total_kt double", "OECD_API"),
    "green_investment": Source(YEAR + "InvestEU_Ops_Count int, InvestEU_Total_EUR double", "InvestEU_EIB"),
    "old_vegetation": Source(MONTH + "NDVI_Mean double, NDVI_Std double", "GEE_MODIS_NDVI"),
    "surface_temperature": Source(MONTH + "LST_Day_C double, LST_Night_C double", "GEE_MODIS_LST"),
    "night_lights": Source(MONTH + "NTL_Mean double, NTL_Std double, NTL_Source string", "GEE_NTL"),
    "renewables": Source("Country string, Year int, Month int, Renewables_Pct double, Source string", "Eurostat_nrg",
                         {"source": "renewables_source"}, entity="country", parts=("year",), country=None),
    "tourism": Source("City string, Country string, Year int, Month int, Tourism_Nights double, Tourism_Source string", "Eurostat_tourism",
                      country=None),
    "carbon_price": Source("Year int, Month int, ETS_Price_EUR double, ETS_Source string", "ETS_EUA", entity=None, parts=("year",), country=None),
    "air_quality": Source("City string, Country string, Year int, Month int, PM25_Mean double, PM10_Mean double, AQ_Source string", "EEA_AQ",
                          country=None),
    "population": Source("City string, Country string, Year int, Population long, Source string", "Eurostat_API",
                         {"city": "city_code", "country": "geo_code", "source": "origin"}, entity="city_code", country="city_code",
                         nulls={"city_name": "string", "obs_flag": "string"},
                         literals={"indic_ur": "POP", "_dataset_code": "population_extract"}),
}


def bronze(df: DataFrame, source: Source, file: str | None = None) -> DataFrame:
    """Raw frame to bronze columns: stored names, country, placeholders, audit."""
    lower = df.toDF(*[c.lower() for c in df.columns])
    out = rename_typed(lower, source.rename, source.nulls)
    out = out.withColumns({k: F.lit(v) for k, v in source.literals.items()}) if source.literals else out
    if source.country:
        out = out.withColumn("country", key_token(source.country))
    if "country_code" in source.parts and "country_code" not in out.columns:
        out = out.withColumn("country_code", F.col("fua_country_code"))
    out = require(out, [c for c in (source.entity, "year") if c])
    return audit(out, source.system, file)


def ingest(spark: SparkSession, name: str, csv_path: str, out_path: str, mode: str = "overwrite", table: str | None = None,
           sources: dict[str, Source] = SOURCES) -> DataFrame:
    """Run one job and return what was stored."""
    source = sources[name]
    raw = read_csv(spark, csv_path, StructType.fromDDL(source.schema), source.mode)
    write_parquet(bronze(raw, source, csv_path.rsplit("/", 1)[-1]), out_path, list(source.parts), mode)
    if table:
        register(spark, table, out_path)
    return spark.read.parquet(out_path)


def ingest_all(spark: SparkSession, paths: dict[str, str], out_root: str, mode: str = "overwrite") -> dict[str, str]:
    """Run several jobs; one that fails is reported and does not stop the others."""
    status = {}
    for name, path in paths.items():
        try:
            ingest(spark, name, path, f"{out_root}/{name}", mode)
            status[name] = "ok"
        except Exception as e:  # a broken source must not block the rest
            log.warning("ingest of %s failed: %s", name, e)
            status[name] = f"failed: {type(e).__name__}"
    return status
