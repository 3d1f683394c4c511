"""litgrid: literature-table curation, alignment and corpus preparation on Spark."""
