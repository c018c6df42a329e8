"""Document intelligence and scoring over corpora, as PySpark DataFrame jobs."""
