"""Change data, slowly changing dimensions, star schema and quality operators."""
