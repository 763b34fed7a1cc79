"""Deterministic clinical notes over the orders table: ASCII text that holds every kind of entity, one note an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflux.cluster import spread
from notaflux.sources.tables import table

#: The text of a note, in SQL that Spark and other engines read alike.
NOTE_TEXT = """'Paciente com ' || (CASE o_custkey % 6 WHEN 0 THEN 'HAS' WHEN 1 THEN 'DM2' WHEN 2 THEN 'pneumonia'
      WHEN 3 THEN 'insuficiencia renal' WHEN 4 THEN 'covid-19' ELSE 'DPOC' END)
  || ' em uso de ' || (CASE o_orderkey % 7 WHEN 0 THEN 'Losartana' WHEN 1 THEN 'Metformina' WHEN 2 THEN 'Omeprazol'
      WHEN 3 THEN 'Furosemida' WHEN 4 THEN 'Ceftriaxona' WHEN 5 THEN 'Dipirona' ELSE 'Varfarina' END)
  || ' ' || CAST((o_custkey % 9 + 1) * 50 AS VARCHAR(10)) || 'mg '
  || (CASE o_orderkey % 5 WHEN 0 THEN '1x/dia' WHEN 1 THEN 'VO de 8/8h' WHEN 2 THEN 'EV a cada 12h'
      WHEN 3 THEN '3 vezes ao dia' ELSE 'SC' END)
  || '. ' || (CASE o_custkey % 4 WHEN 0 THEN 'Solicitada tomografia por febre' WHEN 1 THEN 'Realizada hemodialise'
      WHEN 2 THEN 'Hemograma sem anemia' ELSE 'Nega dor e tosse' END)
  || (CASE WHEN o_orderkey % 3 = 0 THEN '. ' ELSE '.' || CHR(10) END)
  || (CASE WHEN o_orderkey % 11 = 0 THEN 'Demais aparelhos sem alteracoes relevantes no momento da avaliacao; paciente orientado, '
        || 'colaborativo, corado, hidratado, acompanhado por familiar durante toda a consulta. ' ELSE '' END)
  || 'Creatinina: ' || CAST(o_orderkey % 3 AS VARCHAR(10)) || ',' || CAST(o_custkey % 10 AS VARCHAR(10))
  || ' mg/dL. Hemoglobina ' || CAST(8 + o_custkey % 8 AS VARCHAR(10)) || ' g/dL.'
  || (CASE o_custkey % 5 WHEN 0 THEN ' Mantem dispneia em 12/03/2024 as 14:30.' WHEN 1 THEN ' Apos 500mg de paracetamol, melhora.' ELSE '' END)"""


def order_notes(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, text) of all orders; only the two keys are read."""
    return spread(table(spark, root, "orders").select("o_orderkey", "o_custkey")).select(F.col("o_orderkey").alias("note_id"), F.expr(NOTE_TEXT).alias("text"))
