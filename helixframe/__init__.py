"""Spark operators for sequencing reads, gene models, splice junctions and cell barcodes."""
