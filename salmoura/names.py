"""Column names of the data model, declared once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# waste records
PLATFORM = "LOCAL DA GERAÇÃO"
MONTH = "Mes"
WASTE_TYPE = "TIPO DE RESÍDUO"
MASS = "MASSA DO VOLUME (kg)"
MANIFEST = "FCDR"
PERIOD = "Período"

# water tests
FIELD = "CAMPO"
WELL = "POCO"
SITE = "PLATAFORMA"
CODE = "SIGLA"
DATE = "DATA"
WATER_RATE = "QW_M3D"
OIL_RATE = "QO_M3D"
BSW = "BSW"
CHEMISTRY = {"BÁRIO": "BARIO", "ESTRÔNCIO": "ESTRONCIO", "SALINIDADE": "SALINIDADE"}
INGEST_ORDER = "_ordem"
SOURCE_FILE = "_arquivo"

# platform-month
DAYS = "dias_mes"
WATER_MONTH = "QW_mensal_m3"
OIL_MONTH = "QO_mensal_m3"
N_WELLS = "N_POCOS"

# modelling
TARGET = "TEM_NORM"
RATIO = "RELACAO_BA_SR"
FEATURES = ["SALINIDADE", "BARIO", "ESTRONCIO"]


def col(name: str) -> Column:
    """Column by its literal name; several source headers contain dots and blanks."""
    return F.col(f"`{name}`")
