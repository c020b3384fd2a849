"""maskwright: sensitive-data detection, review, suppression and masking as Spark DataFrame plans."""
