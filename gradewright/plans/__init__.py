"""gradewright.plans"""
