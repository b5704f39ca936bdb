"""The SPARQL front end and its compilation to DataFrame plans."""
