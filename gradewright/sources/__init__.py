"""gradewright.sources"""
