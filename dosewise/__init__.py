"""Response modelling and gene-set enrichment over every entity in one Spark job."""
