"""Column expressions: numbers, colours, quaternions, packed codes, Morton codes and spherical harmonics."""
