"""gradewright.streaming"""
