"""Files in and out: sequences, annotations, records."""
