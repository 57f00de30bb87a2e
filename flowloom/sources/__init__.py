"""Sources: HTML links, source trees, Python facts, fragment JSON."""
