"""caduspark: audit, de-identification and attestation analytics on Spark DataFrames."""
