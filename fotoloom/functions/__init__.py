"""Column functions: paths, EXIF values, dates, hashes."""
