"""Writers: season overwrite, dimension upsert, run markers."""
